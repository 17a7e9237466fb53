"""Withholding against a plain fixpoint over random graphs, and whole runs by hand."""

import random

import pytest
from pyspark.sql import functions as F
from quayside.functions import urls
from quayside.operators import pairs, withholding

from .test_pairs import listings, row


def plain_withheld(pending, matches, traits, decided):
    """One listing after the other, a row at most once."""
    same = {frozenset(m) for m in matches}
    match = lambda a, b: frozenset((a, b)) in same

    def conflict(rows):
        detailed = [r for r in rows if traits.get(r, (False, False))[1]]
        return any(traits.get(r, (False, False))[0] for r in rows) and any(not match(a, b) for i, a in enumerate(detailed) for b in detailed[i + 1 :])

    order, skipped, out = {}, set(), set()
    for canonical, row_id, place in sorted(pending, key=lambda p: p[2]):
        order.setdefault(canonical, []).append(row_id)
    for canonical, rows in order.items():
        group, left = [canonical], [r for r in dict.fromkeys(rows) if r not in skipped]
        while joined := [r for r in left if decided.get(r) in group or (any(match(r, m) for m in group) and not conflict([*group, r]))]:
            group += joined
            left = [r for r in left if r not in joined]
        out |= {(canonical, r) for r in group[1:]}
        skipped |= set(group[1:])
    return out


@pytest.mark.parametrize("seed", range(2))
def test_groups_equal_the_plain_fixpoint(spark, seed):
    """Forty separate little worlds a seed: chains, loops, rivals, sessions and decisions."""
    r = random.Random(seed)
    pending, matches, traits, decided, place = [], [], {}, {}, 0
    want = set()
    for world in range(40):
        heads, rows = [f"w{world}c{k}" for k in range(r.randint(1, 3))], [f"w{world}r{k}" for k in range(r.randint(1, 7))]
        here = []
        for head in heads:
            for i in rows:
                if r.random() < 0.7:
                    here.append((head, i, place))
                    place += 1
        nodes = heads + rows
        links = [(a, b) for k, a in enumerate(nodes) for b in nodes[k + 1 :] if r.random() < 0.35]
        links += [(a, b) for a, b in zip(rows, rows[1:]) if r.random() < 0.5]
        kinds = {n: r.choice([(False, False)] * 2 + [(True, False), (False, True), (False, True)]) for n in nodes}
        said = {i: r.choice(heads) for i in rows if r.random() < 0.1}
        want |= plain_withheld(here, links, kinds, said)
        pending, matches, traits, decided = pending + here, matches + links, traits | kinds, decided | said
    as_df = lambda rows, schema: spark.createDataFrame(rows, schema)
    args = (
        as_df([(c, i, (p,)) for c, i, p in pending], "canonical string, id string, place struct<n:int>"), as_df(matches, "l_id string, r_id string"),
        as_df([(n, *t) for n, t in traits.items()], "id string, incomplete boolean, detailed boolean"), as_df(list(decided.items()) or [("none", "none")], "id string, kept string"),
    )
    assert {(x.canonical, x.id) for x in withholding.withheld_rows(*args).collect()} == want


def test_a_long_chain_and_a_loop(spark):
    chain = [(f"r{k}", f"r{k + 1}") for k in range(12)] + [("head", "r0"), ("r12", "r5"), ("x", "y")]
    pending = spark.createDataFrame([("head", f"r{k}", (k,)) for k in range(13)] + [("head", "x", (50,)), ("head", "y", (51,))], "canonical string, id string, place struct<n:int>")
    none = spark.createDataFrame([], "id string, incomplete boolean, detailed boolean"), spark.createDataFrame([], "id string, kept string")
    got = withholding.withheld_rows(pending, spark.createDataFrame(chain, "l_id string, r_id string"), *none)
    assert sorted(x.id for x in got.collect()) == sorted(f"r{k}" for k in range(13))


def permalink(number):
    digits = ""
    while number:
        digits, number = urls.SHORTCODE[number % 64] + digits, number // 64
    return f"https://www.instagram.com/p/{digits or 'A'}/"


def table(spark, rows, columns=()):
    """listings of (row, link, *columns) with their further columns."""
    df = listings(spark, [r for r, *_ in rows])
    more = spark.createDataFrame([(r[0], *rest) for r, *rest in rows], "id string, link string" + "".join(f", {c}" for c in columns))
    return df.join(more, "id").withColumn("source_url", F.col("link")).withColumn("image_url", F.lit(None).cast("string")).drop("link")


REGISTRY = "source_key string, assessment string, event_ids array<string>, known_event_ids array<string>, deleted boolean"
NEW = ("source_key string", "position int", "row_no int", "assessment string")


def run(spark, proposed, registry, live, **more):
    out = withholding.withhold(table(spark, proposed, NEW), spark.createDataFrame(registry, REGISTRY), table(spark, live), **more)
    return {(r.id, r.published_from): r for r in out.collect()}


def post(n):
    return f"instagram:post:{n}"


class World:
    """Posts of one account, so that many worlds run at once: club names differ, and so do numbers."""

    def __init__(self, n):
        self.n, self.proposed, self.stored, self.live = n, [], [], []

    def id(self, k, session=""):
        return f"ig_club{self.n}_p{100 * self.n + k}{session}"

    def row(self, k, title="Grandmaster Simul", session="", **more):
        return row(self.id(k, session), title, host=f"Club {self.n}", handle=f"club{self.n}", **more)

    def link(self, k):
        return permalink(100 * self.n + k)

    def key(self, k):
        return post(100 * self.n + k)

    def first(self, **more):
        """Post 1 and its listing."""
        self.live.append((self.row(1, **more), None))
        self.stored.append((self.key(1), "a", [self.id(1)], [self.id(1)], False))
        self.proposed.append((self.row(1), None, self.key(1), 10 * self.n, 0, "a"))
        return self

    def again(self, k, decision="b", known=True, link=None, **more):
        """Post k, merged into listing 1 before."""
        self.stored.append((self.key(k), "b", [self.id(1)], [self.id(k)] if known else [], False))
        self.proposed.append((self.row(k, **more), link, self.key(k), 10 * self.n + k, 0, decision))
        return self


def test_whole_runs(spark):
    """Every world is one case; all run at once."""
    strange = {"title": "Pottery", "place": "Barn", "s": "2026-10-05 23:00:00"}
    held = World(1).first().again(2, food=True, url="https://forms.gle/simul")
    replayed = World(2).first(food=True, url="https://forms.gle/simul").again(2, food=True, url="https://forms.gle/simul")
    changed, unknown, other, decided = World(3).first().again(2, decision="c"), World(4).first().again(2, known=False), World(5).first().again(2, **strange), World(6).first().again(2, **strange)
    missing = World(7).again(2)
    sessions, alone, locked = World(8), World(9), World(10)
    for w in (sessions, alone, locked):
        w.live.append((w.row(1, locked=w is locked), None))
        w.stored.append((w.key(2), "b", [w.id(2, "-b2"), w.id(1)], [w.id(2, "-a1"), w.id(2, "-b2"), w.id(1)], False))
        w.proposed += [(w.row(2, session="-a1"), None, w.key(2), 10 * w.n, 0, "b"), (w.row(2, "Blitz Evening", "-b2", s="2026-10-07 20:00:00"), None, w.key(2), 10 * w.n, 1, "b")]
    sessions.stored.append((sessions.key(1), "a", [sessions.id(1)], [sessions.id(1)], False))
    gone, judged, kept = World(11), World(12), World(13)
    for w in (gone, judged, kept):
        w.live.append((w.row(1, locked=w is kept), w.link(1)))
        w.stored.append((w.key(1), "a", [], [w.id(1)], True))
        w.again(2, link=w.link(2)).again(3, link=w.link(3), place="")
    worlds = [held, replayed, changed, unknown, other, decided, missing, sessions, alone, locked, gone, judged, kept]
    every = lambda name: [x for w in worlds for x in getattr(w, name)]
    forced = spark.createDataFrame([(decided.id(2), decided.id(1))], "old string, new string")
    different = spark.createDataFrame([(judged.id(1), judged.id(3))], "a string, b string")
    got = run(spark, every("proposed"), every("stored"), every("live"), forced=forced, different=different)
    of = lambda w: {k for k in got if f"_club{w.n}_" in k[1]}
    own = lambda w, *ks: {(w.id(*k), w.id(*k)) for k in ks}
    assert of(held) == own(held, (1,)) and of(replayed) == own(replayed, (1,)) and of(decided) == own(decided, (1,))
    for w in (held, replayed):
        merged = got[w.id(1), w.id(1)]
        assert merged.has_free_food and merged.rsvp_url == "https://forms.gle/simul"
    assert all(of(w) == own(w, (1,), (2,)) for w in (changed, unknown, other)) and of(missing) == own(missing, (2,))
    # a session is withheld only where the listing survives without it
    assert of(sessions) == own(sessions, (2, "-b2")) and of(alone) == own(alone, (2, "-a1"), (2, "-b2")) and of(locked) == own(locked, (2, "-b2"))
    # the newest repeat takes over from a deleted post, unless judged different or the listing is locked
    assert of(gone) == {(gone.id(1), gone.id(3))} and of(judged) == {(judged.id(1), judged.id(2))} and not of(kept)
    taken = got[gone.id(1), gone.id(3)]
    assert taken.source_url == gone.link(3) and taken.location == "HUB 302"


def test_preferred_reposts(spark):
    rows = [
        (row("ig_chess_p1", "Grandmaster Simul", text="old words"), permalink(1)), (row("ig_chess_p2", "Grandmaster Simul", text="new words"), permalink(2)),
        (row("ig_chess_p3", "Grandmaster Simul", text=""), permalink(3)), (row("ig_chess_p4", "Grandmaster Simul", text="vague", place=""), permalink(4)),
        (row("ig_a_p5", "Lantern Parade", handle="a", host="A", url="https://forms.gle/x"), permalink(5)), (row("ig_a_p6", "Lantern Parade", handle="a", host="A"), permalink(6)),
    ]
    known = pairs.cut(pairs.facts(table(spark, rows)))
    matches = spark.createDataFrame([(a[0][0], b[0][0]) for k, a in enumerate(rows) for b in rows[k + 1 :] if a[0][5] == b[0][5]], "l_id string, r_id string")
    none = spark.createDataFrame([], "id string, kept string")
    best = lambda m=matches, d=none, x=None: {r.winner: r.source for r in withholding.preferred_reposts(known.select("id"), known, m, d, x).collect()}
    # the third says nothing, the fourth names no venue, the sixth has no link
    assert best() == {"ig_chess_p1": "ig_chess_p2"}
    assert "ig_chess_p1" not in best(d=spark.createDataFrame([("ig_z", "ig_chess_p1")], "id string, kept string"))
    assert "ig_chess_p1" not in best(x=spark.createDataFrame([("ig_chess_p1", "ig_chess_p2")], "a string, b string"))


def test_no_rows(spark):
    empty = table(spark, [(row("x", "y"), None, "k", 0, 0, "a")], NEW).limit(0)
    out = withholding.withhold(empty, spark.createDataFrame([], REGISTRY), table(spark, [(row("ig_chess_p1", "z"), None)]))
    assert out.count() == 0
