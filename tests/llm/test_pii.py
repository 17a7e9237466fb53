from pyspark.sql import functions as F
from quayside.llm import queries
from quayside.llm.pii import GIVEN, TYPES, draw_surrogates, find_entities, replace_entities, surrogate

KEY = b"test"


def test_entities():
    text = "Mail jo.el+x@mail.example.com, call +1 (275) 555-5927 or 106.158.249.239 or 2001:db8::7; card 4177177023978468, 078-05-1120. Mrs Anna Keller and Herr Schmidt at 12:30:45"
    assert [(t, text[s:e]) for t, _, s, e, _ in find_entities(text)] == [
        ("email", "jo.el+x@mail.example.com"), ("phone", "+1 (275) 555-5927"), ("ip", "106.158.249.239"), ("ip6", "2001:db8::7"), ("card", "4177177023978468"), ("ssn", "078-05-1120"),
        ("given", "Anna"), ("family", "Keller"), ("family", "Schmidt"),
    ]
    assert find_entities("version 1.2.3 in 2024, 555 people, 12345, a::b and std::vector") == []
    long = "x" * 400 + "@h.example.com"
    assert [(s, e) for _, _, s, e, _ in find_entities("to " + long)] == [(3, 3 + len(long))]


def test_mentions_of_a_person_stay_one(spark):
    text = "Mrs Anna Keller came. Anna Keller said so, Dr Anna Keller's book, KELLER, Anna; Mrs Keller left, a keller. Mr Ben Keller stayed. My name is Eva Maria Lopez, yes Eva Lopez."
    docs = spark.createDataFrame([(1, text), (2, "Dr Anna Keller and Prof Keller"), (3, "Anna Keller is not introduced")], "doc_id long, text string")
    got = {r.doc_id: r for r in replace_entities(docs, KEY).collect()}
    assert got[3].text == "Anna Keller is not introduced"
    old = {t: n for t, n in zip(*(zip(*[(text[s:e].casefold(), k) for k, _, s, e, _ in find_entities(text)], strict=True)), strict=True)}
    assert old == {"anna": "given", "keller": "family", "ben": "given", "eva": "given", "maria": "given", "lopez": "family"}
    words, new = text.replace("'s", " s").split(), got[1].text.replace("'s", " s").split()
    bare = lambda w: w.strip(".,;").casefold()
    pairs = {(bare(a), bare(b)) for a, b in zip(words, new, strict=True) if bare(a) in old}
    assert len(pairs) == len(old) + 1 and ("keller", "keller") in pairs  # "a keller" is no name
    mapped = dict(p for p in pairs if p[0] != p[1])
    assert len(set(mapped.values())) == len(old) and not set(mapped.values()) & set(old)
    assert mapped["anna"].capitalize() in GIVEN["latin", "f"] and mapped["ben"].capitalize() in GIVEN["latin", "m"]
    assert got[2].text == f"Dr {mapped['anna'].capitalize()} {mapped['keller'].capitalize()} and Prof {mapped['keller'].capitalize()}"
    assert mapped["keller"].upper() in got[1].text


def test_whole_query_against_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    to, of, real, n = {}, {}, set(), 0
    for r in queries.QUERIES["op6_pii_surrogates"](spark, folder).collect():
        text, at, left = texts[r.doc_id], 0, r.text
        found = find_entities(text)
        assert r.n_entities == len(found) and r.spans == ",".join(f"{t}:{s}:{e}" for t, _, s, e, _ in found)
        assert sum(r[f"n_{t}"] for t in TYPES) == len(found)
        new = find_entities(r.text)
        if len(new) == len(found):
            for (t, norm, s, e, _), (u, made, a, b, _) in zip(found, new, strict=True):
                assert (t, text[at:s]) == (u, left[: a - (len(r.text) - len(left))])
                at, left = e, r.text[b:]
                assert to.setdefault((t, norm), made) == made and of.setdefault((t, made), norm) == norm
                n += 1
            assert text[at:] == left
        real |= {(t, norm) for t, norm, *_ in found}
    assert n > 50 and not {k for k in of if k in real}


def test_coreference_distinctness_and_format(spark):
    rows = [(i, f"call +1 ({200 + i % 40}) 555-{1000 + i % 40} or 10.0.0.{i % 200}, mail a{i % 60}@x.example.com Mrs Anna Keller") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    old, new = {}, {}
    for r in replace_entities(docs, KEY).collect():
        a, b = find_entities(rows[r.doc_id][1]), find_entities(r.text)
        assert [x[0] for x in a] == [x[0] for x in b] and r.n_entities == len(a)
        for x, y in zip(a, b, strict=True):
            assert old.setdefault(x[:2], y[:2]) == y[:2] and new.setdefault(y[:2], x[:2]) == x[:2]
    assert not set(old) & set(new) and len(old) == len(new)


def test_collisions_are_drawn_again(spark, monkeypatch):
    # one-letter local parts at one host: 26 addresses have hardly more surrogates
    norms = [("email", f"{c}@h.example.com", "n") for c in "abcdefghijkl"]
    got = draw_surrogates(spark.createDataFrame(norms, "type string, norm string, gender string"), KEY).collect()
    values = [r.surrogate for r in got]
    assert len(values) == len(set(values)) == 12 and not set(values) & {n for _, n, _ in norms}
    # 400 given names have hardly more than a dozen first choices
    norms = [("given", f"name{i}", "f") for i in range(400)]
    got = draw_surrogates(spark.createDataFrame(norms, "type string, norm string, gender string"), KEY).collect()
    assert len({r.surrogate for r in got}) == 400


def test_surrogates_keep_gender_script_and_check_digit():
    from quayside.llm.pii import _luhn

    assert surrogate("given", "anna", 0, KEY, "f").capitalize() in GIVEN["latin", "f"]
    assert surrogate("given", "иван", 0, KEY, "m").capitalize() in GIVEN["cyrillic", "m"]
    assert _luhn(surrogate("card", "4539148803436467", 0, KEY)) == _luhn("4539148803436467")
    assert surrogate("ip", "1.2.3.4", 0, KEY) == surrogate("ip", "1.2.3.4", 0, KEY) != surrogate("ip", "1.2.3.4", 0, b"other")


def test_awkward_rows(docs, no_docs):
    got = replace_entities(docs, KEY)
    assert got.count() == docs.count()
    assert sorted(r.text for r in got.filter(F.col("n_entities") == 0).collect())
    assert replace_entities(no_docs, KEY).count() == 0


def test_full_formats_end(spark):
    """All hundred two-digit and all 26 one-letter addresses of a host, under several keys, and a host whose every neighbour is taken."""
    from quayside.llm.pii import draw_surrogates

    names = [f"{k:02d}@h.example.com" for k in range(100)] + [f"{c}@x.example.org" for c in "abcdefghijklmnopqrstuvwxyz"] + [f"{k}@{h}.de" for k in range(10) for h in "abcdefghijklmnopqrstuvwxyz"]
    entities = spark.createDataFrame([("email", n, "n") for n in names], "type string, norm string, gender string")
    for key in (b"one", b"two"):
        got = {r.norm: r.surrogate for r in draw_surrogates(entities, key).collect()}
        assert set(got) == set(names) and len(set(got.values())) == len(names) and not set(got.values()) & set(names)
        same = [n for n in names if len(got[n]) == len(n)]
        assert len(same) >= 126 and all(n in same for n in names[:126])
    assert draw_surrogates(entities.limit(0), b"k").count() == 0
