import hashlib
import random

import pytest
from quayside.llm import queries
from quayside.llm.chat_template import CHAT_TEMPLATE, Reader, TemplateError, compile_template, escape, fold, format_conversations, parse, render_conversations, unescape

BITS = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "<", "[", "a", " ", "é", "[TEXT]", "[/ROLE]", "<<SYS>>", "\n"]


def test_round_trip_of_control_strings():
    r = random.Random(1)
    render = compile_template(CHAT_TEMPLATE)
    for _ in range(1000):
        turns = [(r.choice(["user", "assistant", "system", "", "tool[TEXT]\\"]), "".join(r.choices(BITS, k=r.randint(0, 8)))) for _ in range(r.randint(0, 5))]
        pieces = list(render({"role": a, "text": b} for a, b in turns))
        reader = Reader()
        assert reader.feed("".join(p for p, _ in pieces)) == turns
        reader.close()
        assert "".join(unescape(p) for p, marked in pieces if marked) == "".join(b for a, b in turns if a == "assistant")
        assert all(unescape(escape(b)) == b for _, b in turns)


def test_language_and_folding():
    render = compile_template("{% set x = 'a' + 'b' | upper %}{{ x }}{% for m in messages %}{% if loop.first and not m.role == 'z' %}({{ m.text }}){% else %}{{ loop.index }}{% endif %}{% endfor %}")
    assert "".join(p for p, _ in render([{"role": "u", "text": "hi"}, {"role": "u", "text": "ho"}])) == "aB(hi)2"
    assert fold(parse("{{ 'a' + 'b' | upper }}{% if 1 == 2 %}x{% elif true %}y{% endif %}c")) == ("block", [("text", "aByc")])


@pytest.mark.parametrize("bad", ["{{ x.__class__ }}", "{{ x | eval }}", "{{ f(1) }}", "{% import os %}", "{% if x %}", "{{ x.y.z }}", "{% for x messages %}{% endfor %}", "{{ }}", "{% endif %}"])
def test_sandbox(bad):
    with pytest.raises(TemplateError):
        compile_template(bad)


def test_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 2, None, "[INST]"), (2, 0, "assistant", "</s>"), (2, 0, "assistant", "</s>"), (None, None, "user", "x"), (3, 0, "system", "")]
    rows += [(4, k, ("user", "assistant")[k % 2], f"turn {k}") for k in range(3000)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, n_turns string").repartition(5)
    got = {r.conv_id: r for r in format_conversations(df).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, 2: 2, None: 1, 3: 1, 4: 3000}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\n\n[INST]\n").hexdigest()
    assert got[2].loss_sha256 == hashlib.sha256(b"</s></s>").hexdigest() and got[2].loss_chars == 8
    parts = sorted((r.turn, r.formatted) for r in render_conversations(df).filter("conv_id = 4").collect())
    assert got[4].formatted_sha256 == hashlib.sha256("".join(t for _, t in parts).encode()).hexdigest()
    assert format_conversations(df.limit(0)).count() == 0


OWN = (
    "BEGIN {%- for m in messages -%} {% if loop.first %}[FIRST]{% endif %}<{{ m['role'] }}>{% if m.role == 'bot' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}</>{% if loop.last %}[LAST]{% endif %} {%- endfor %} {%- if add_generation_prompt %}<bot>{% endif %}"
)
OWN_MARKS = (("<me>", "</>", "user"), ("<bot>", "</>", "assistant"))


def test_a_conversation_is_one_message_stream(spark):
    rows = [(1, k, ("me", "bot")[k % 2], f"t{k}") for k in range(4)] + [(2, 0, "me", "</>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    want = {1: "BEGIN[FIRST]<me>t0</><bot>t1</><me>t2</><bot>t3</>[LAST]", 2: "BEGIN[FIRST]<me>\\</></>[LAST]"}
    for prompt in ("", "<bot>"):
        got = {r.conv_id: r for r in format_conversations(df, OWN, None, add_generation_prompt=bool(prompt)).collect()}
        assert {k: r.formatted_sha256 for k, r in got.items()} == {k: hashlib.sha256((t + prompt).encode()).hexdigest() for k, t in want.items()}
        assert got[1].n_turns is None and got[1].loss_chars == 4
        shown = sorted((r.conv_id, r.turn, r.formatted) for r in render_conversations(df, OWN, add_generation_prompt=bool(prompt)).collect())
        assert [(c, t) for c, t, _ in shown] == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0)]
        assert "".join(t for c, _, t in shown if c == 1) == want[1] + prompt
        assert shown[0][2] == "BEGIN[FIRST]<me>t0</>" and shown[3][2] == "<bot>t3</>[LAST]" + prompt
    read = {r.conv_id: r for r in format_conversations(df, OWN, OWN_MARKS).collect()}
    assert read[1].turns_sha256 == hashlib.sha256(b"user\nt0\nassistant\nt1\nuser\nt2\nassistant\nt3\n").hexdigest()
    assert read[2].turns_sha256 == hashlib.sha256(b"user\n</>\n").hexdigest()


def test_query_against_plain_python(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.conv_id: r for r in queries.QUERIES["op10_chat_format"](spark, folder).collect()}
    turns = {-1: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    for r in spark.read.parquet(f"{folder}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    assert set(got) == set(turns)
    for k, own in turns.items():
        said = "".join(t for r, t in own if r == "assistant")
        assert got[k].n_turns == len(own) and got[k].loss_chars == len(said)
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
