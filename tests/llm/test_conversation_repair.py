"""Conversation repair against a search over all edit scripts, against its SQL, and over hand-made conversations."""

import functools
import hashlib
import random
import re

import duckdb
import pytest
from quayside.llm import conversation_repair as repair
from quayside.llm import queries

SCHEMA = "conv_id long, turn long, role string, text string, copies int"


def search(initials, faults):
    """The least (cost, audit) over all edit scripts, one turn at a time."""
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @functools.cache
    def best(i, q):
        if i == len(initials):
            return {"": (0, ""), "a": (0, ""), "u": (3, "I"), "s": (6, "II")}[q]
        cost, rest = best(i + 1, q)
        found = [(cost + 4, "D" + rest)]
        if faults[i] in (repair.SOUND, repair.CUT):
            own = 3 * (faults[i] == repair.CUT)
            for inserted, before in [("", q)] + [("I", r) for r in follows[q] if r != "s"]:
                for role in follows[before]:
                    if initials[i] == role or role != "s":
                        edit, price = ("K", 0) if initials[i] == role else ("R", 3)
                        cost, rest = best(i + 1, role)
                        found.append((cost + own + price + 3 * len(inserted), inserted + edit + rest))
        return min(found)

    return best(0, "")


@pytest.mark.parametrize("seed", range(8))
def test_cheapest_audit(seed):
    r = random.Random(seed)
    for _ in range(500):
        n = r.randint(0, 9)
        initials = "".join(r.choice("suua?a") for _ in range(n))
        faults = bytes(r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        assert repair.cheapest_audit(initials, faults) == search(initials, faults), (initials, faults)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_query_equals_its_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '/root/testdata/{folder}/conversations.parquet'")
    want = con.execute(queries.ORACLES["op12_conversation_repair"])
    names = [d[0] for d in want.description]
    got = queries.QUERIES["op12_conversation_repair"](spark, f"/root/testdata/{folder}")
    assert got.columns == names
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def reports(spark, rows):
    df = spark.createDataFrame([(*row, 1) for row in rows], SCHEMA).repartition(3)
    turns = sorted((r for r in repair.repaired_turns(df).collect()), key=lambda r: (r.conv_id is not None, r.conv_id, r.place))
    return {r.conv_id: r for r in repair.repair_digests(df).collect()}, turns


def test_conversations(spark):
    rows = [
        (1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!"),
        (2, 0, "user", "Hi."), (2, 3, "user", "Are you there?"), (2, 4, "assistant", "Yes"),
        (3, 0, "user", " \t\n"), (3, 1, "assistant", "  "),
        (None, None, "assistant", "Who?"), (None, 5, "user", "Me."), (None, 5, "user", "Me."),
        (4, 0, "tool", "x."), (4, 1, "", "y. \r\n"), (5, 0, "system", "Only."),
        (6, 0, "user", "same."), (6, 1, "assistant", "same."), (6, 2, "user", "same."), (6, 3, "assistant", "other."),
    ]
    found, turns = reports(spark, rows)
    counts = {k: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for k, r in found.items()}
    assert counts == {
        1: (0, 0, 0, 0, 0, 0, "KKK"),
        2: (2, 0, 0, 1, 1, 6, "KIKK"),
        3: (0, 2, 0, 0, 0, 8, "DD"),
        None: (0, 0, 1, 0, 1, 10, "IKKDI"),
        4: (0, 0, 0, 0, 1, 6, "RR"),
        5: (0, 0, 0, 0, 0, 4, "D"),
        6: (0, 0, 1, 0, 0, 7, "KKDIK"),
    }
    for key, r in found.items():
        lines = [f"{t.role}:{t.text}" for t in turns if t.conv_id == key]
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in turns if t.conv_id == key))
    assert [(t.role, t.text, t.edit) for t in turns if t.conv_id is None] == [("user", "", "I"), ("assistant", "Who?", "K"), ("user", "Me.", "K"), ("assistant", "", "I")]


def test_long_and_hot_conversation(spark):
    """One conversation holds nearly all rows, and one text nearly all of it; the batch size is small beside it."""
    rows = [(7, k, "user" if k % 2 else "assistant", "ok." if k % 3 else f"turn {k}.") for k in range(6000)] + [(8, 0, "user", "x."), (8, 1, "assistant", "y.")]
    found, turns = reports(spark, rows)
    initials = "".join("u" if k % 2 else "a" for k in range(6000))
    seen, faults = set(), []
    for _, _, role, text in rows[:6000]:
        faults.append(repair.DUPLICATE if (role, text) in seen else repair.SOUND)
        seen.add((role, text))
    assert (found[7].cost, found[7].audit) == repair.cheapest_audit(initials, bytes(faults))
    assert found[7].duplicate == faults.count(repair.DUPLICATE) and found[8].cost == 0
    lines = [f"{t.role}:{t.text}" for t in turns if t.conv_id == 7]
    assert found[7].repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()


def test_nothing_left(spark):
    df = spark.createDataFrame([(1, 0, "user", "Hi.", 0)], SCHEMA)
    (row,) = repair.repair_digests(df).collect()
    assert tuple(row) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair.repaired_turns(df).count() == 0
