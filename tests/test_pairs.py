"""Pair rules, scores and grouping on small invented listings: for each rule one pair that it joins and one that it leaves."""

import pytest
from pyspark.sql import functions as F
from quayside.operators import dedupe, grouping, pairs, shadow
from quayside.sources import tables

SCHEMA = (
    "id string, title string, description string, location string, host string, host_handle string, s string, e string, all_day boolean, content_kind string, "
    "source string, has_free_food boolean, is_locked boolean, rsvp_url string, source_url string"
)
LONG = "Sign up for the spring intake of our mentoring circle. We close the list on {} and then write to everybody who is in."


def row(i, title, place="HUB 302", s="2026-10-05 20:00:00", e=None, host="Chess Club", handle="chess", text="", kind="student_event", all_day=False, url=None, link=None, locked=False, food=False):
    return (i, title, text, place, host, handle, s, e, all_day, kind, "instagram", food, locked, url, link)


MIDNIGHT, NEXT, THIRD = "2026-10-05 07:00:00", "2026-10-06 07:00:00", "2026-10-08 07:00:00"
CASES = {
    "siblings": (row("ig_chess_p9-20261005T2000Z", "Blitz Evening"), row("ig_chess_p9-20261005T2000Z-abc", "Blitz Evening"), False),
    "same source": (row("ig_chess_p91", "Blitz Evening"), row("ig_post_91_20261005T2000Z", "Something else", place="Barn"), True),
    "numbered repeat": (row("ig_chess_p1", "Day 2: Opening Talks"), row("ig_chess_p2", "Opening Talk", place=""), True),
    "corrected schedule": (
        row("ig_chess_p1-a1", "Endgame Study Circle", place="HUB 302", text="our quarter"),
        row("ig_chess_p2-a1", "Endgame Study Circle", place="Barn", text="This is the updated schedule"),
        True,
    ),
    "unnumbered repeat": (row("ig_chess_p1", "GM #1 - Intro to Gambits"), row("ig_chess_p2", "First Member Meeting"), True),
    "contradiction": (row("ig_chess_p1", "Silent Blitz Session 1"), row("ig_chess_p2", "Silent Blitz Session 2"), False),
    "same slot": (row("ig_chess_p1", "Boba Social", e="2026-10-05 22:00:00"), row("ig_chess_p2", "Designing Dreams", e="2026-10-05 22:00:00", place=""), True),
    "shared occasion": (row("ig_chess_p1", "Latinx Heritage Soccer Night", place="Soccer Stadium"), row("ig_bears_p2", "Varsity Game Latin Heritage Soccer", place="Soccer Stadium", host="Bears", handle="bears"), True),
    "corrected deadline": (
        row("ig_chess_p1", "Mentoring Intake Deadline", kind="student_deadline", text=LONG.format("Oct 5")),
        row("ig_chess_p2", "Mentoring Intake Deadline", kind="student_deadline", text=LONG.format("Oct 19"), s="2026-10-19 20:00:00"),
        True,
    ),
    "superseded schedule": (row("ig_chess_p1-a1", "First General Meeting", place="HUB 269"), row("ig_chess_p2", "Trivia Night", place="HUB 260"), True),
    "same span": (
        row("ig_chess_p1", "Family Weekend", place="", s=MIDNIGHT, e=THIRD, all_day=True),
        row("ig_bears_p2", "Autumn Family Weekend 2026", place="", s=MIDNIGHT, e=THIRD, all_day=True, host="Bears", handle="bears"),
        True,
    ),
    "quoted story": (
        row("ig_chess_p1", "it has been a while", place="", s=MIDNIGHT, all_day=None, link="https://www.instagram.com/stories/chess/1"),
        row("ig_chess_p2", "Film Evening", text="Come to It has been a while, our film"),
        True,
    ),
    "check-in": (row("ig_chess_p1", "Ride to the Museum", url="https://forms.gle/ride"), row("ig_chess_p2", "Museum Trip", url="https://forms.gle/ride", s="2026-10-05 20:10:00"), True),
    "places conflict": (row("ig_chess_p1", "Blitz Evening", e="2026-10-05 22:00:00"), row("ig_bears_p2", "Blitz Evening", place="Barn", e="2026-10-05 22:00:00", host="Bears", handle="bears"), False),
    "summary": (row("ig_fest_p1-a1", "Lantern Parade", place="", s=MIDNIGHT, e=NEXT, all_day=True, host="Fest", handle="fest"), row("ig_chess_p2", "Lantern Parade"), True),
    "starts differ": (row("ig_chess_p1", "Endgame Study Circle", s=MIDNIGHT, e=NEXT, all_day=True), row("ig_chess_p2", "Endgame Study Circle"), True),
    "ends differ": (row("ig_chess_p1", "Blitz", place="", e="2026-10-05 22:00:00"), row("ig_chess_p2", "Blitz Fun", place="", e="2026-10-05 23:00:00"), False),
    "same key": (row("ig_chess_p1", "Blitz", place=""), row("ig_chess_p1-a1b", "Blitz", place="", host="Other"), None),
    "deadline": (
        row("ig_chess_p1", "Registration for Simul closes", kind="student_deadline", url="https://forms.gle/simul"),
        row("ig_bears_p2", "Application for Simul closes", kind="student_deadline", url="https://forms.gle/simul", host="Bears", handle="bears"),
        True,
    ),
    "repeat": (row("ig_chess_p1", "Grandmaster Simul Show", text="with @bears", e="2026-10-05 22:00:00"), row("ig_bears_p2", "Grandmaster Simul", host="Bears", handle="bears"), True),
}


def listings(spark, rows):
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    return spark.createDataFrame(rows, SCHEMA).withColumns({"starts_at": ntz("s"), "ends_at": ntz("e")}).drop("s", "e")


def test_rules(spark):
    got = {}
    rows = []
    for n, (left, right, _) in enumerate(CASES.values()):
        # handles differ by case, so that cases never meet; posts keep their numbers
        own = lambda r, n=n: (r[0].replace("ig_", f"ig_c{n}", 1) if not r[0].startswith("ig_post") else r[0], *r[1:5], f"c{n}{r[5]}", *r[6:])
        rows.append([own(left), own(right)])
    for n, name in enumerate(CASES):
        rows[n] = [tuple(v.replace("@bears", f"@c{n}bears") if isinstance(v, str) else v for v in r) for r in rows[n]]
    known = dedupe.cut(pairs.facts(listings(spark, [r for two in rows for r in two])))
    wanted = spark.createDataFrame([tuple(sorted((a[0], b[0]))) for a, b in rows], "l_id string, r_id string")
    for r in pairs.same_event(pairs.with_sides(wanted, known)).select("l_id", "r_id", "verdict", "rule").collect():
        got[frozenset((r.l_id, r.r_id))] = (r.verdict, r.rule)
    for (name, (_, _, want)), (a, b) in zip(CASES.items(), rows, strict=True):
        verdict, rule = got[frozenset((a[0], b[0]))]
        if want is not None:
            assert (name, verdict) == (name, want), (name, verdict, rule)
            assert rule == name, (name, rule)
    made = {frozenset((r.l_id, r.r_id)) for r in pairs.candidate_pairs(known).select("l_id", "r_id").collect()}
    for (name, (_, _, want)), (a, b) in zip(CASES.items(), rows, strict=True):
        assert not want or frozenset((a[0], b[0])) in made, name  # the join makes every pair that a rule joins


def test_facts_of_places_and_hosts(spark):
    rows = [row("ig_pop_p1", "Pride of Poets presents Slam", place="Student Success Center 114, Riverside, CA", host="Pride of Poets (POP)", handle="popucr"), row("ig_x_p2", "x", place="Zoom link in bio", host="Career Center", handle="career")]
    got = {r.id: r for r in pairs.facts(listings(spark, rows)).collect()}
    assert set(got["ig_pop_p1"].f_place) == {"ssc", "114"} and got["ig_x_p2"].f_place == ["virtual"]
    assert ["pop"] in got["ig_pop_p1"].f_aliases and got["ig_pop_p1"].f_media == ["1"]
    two = pairs.with_sides(spark.createDataFrame([("ig_pop_p1", "ig_x_p2")], "l_id string, r_id string"), dedupe.cut(pairs.facts(listings(spark, rows))))
    form = two.select(pairs.title_form("l", "r").alias("f")).first().f
    assert (form.words, form.found) == (["slam"], True)


def test_score_of_a_clear_repeat_and_of_strangers(spark):
    rows = [
        row("ig_chess_p1", "Grandmaster Simul", e="2026-10-05 22:00:00"), row("ig_chess_p2", "Grandmaster Simul", e="2026-10-05 22:00:00"), row("ig_bears_p3", "Pottery", place="Barn", host="Bears", handle="bears", s="2026-10-06 01:00:00"),
    ] + [row(f"ig_o{k}_p{k + 10}", f"Filler {k}", handle=f"o{k}", s="2026-11-01 20:00:00") for k in range(40)]
    known = dedupe.cut(pairs.with_rarity(pairs.facts(listings(spark, rows))))
    wanted = spark.createDataFrame([("ig_chess_p1", "ig_chess_p2"), ("ig_bears_p3", "ig_chess_p1")], "l_id string, r_id string")
    got = {r.l_id: r for r in pairs.pair_score(pairs.with_sides(wanted, known)).collect()}
    same, other = got["ig_chess_p1"], got["ig_bears_p3"]
    assert same.title_spelling == 1 and same.title_subset == 1 and same.place_same == 1 and same.slot_venue_word == same.title_rare_shared > 0.4
    total = pairs.BIAS + sum(w * same[n] for n, w in pairs.WEIGHTS.items())
    assert same.score == pytest.approx(1 / (1 + 2.718281828459045**-total)) and same.advice in ("merge", "review") and same.score > 0.95
    assert other.cross_far_start == 1 and other.place_conflict == 1 and other.score < 0.01 and other.advice == "dismiss"


def test_ambiguous_teasers_and_summaries_join_nothing(spark):
    rows = [
        row("ig_chess_p1", "Endgame Study Circle", s=MIDNIGHT, e=NEXT, all_day=True), row("ig_chess_p2", "Endgame Study Circle", s="2026-10-05 18:00:00"), row("ig_chess_p3", "Endgame Study Circle", s="2026-10-05 23:00:00"),
        row("ig_fest_p4-a1", "Lantern Parade", place="", s=MIDNIGHT, e=NEXT, all_day=True, host="Fest", handle="fest"),
        row("ig_a_p5", "Lantern Parade", place="Barn", handle="a", host="A"), row("ig_b_p6", "Lantern Parade", place="HUB 302", handle="b", host="B"),
    ]
    _, groups = grouping.plan(listings(spark, rows))
    assert {r.id: r.group_id for r in groups.collect()} == {r[0]: r[0] for r in rows}
    _, groups = grouping.plan(listings(spark, rows[:2] + rows[3:5]))
    found = {r.id: r.group_id for r in groups.collect()}
    assert found["ig_chess_p2"] == "ig_chess_p1" and found["ig_fest_p4-a1"] == found["ig_a_p5"]


def test_survivors_and_removals(spark):
    rows = [
        row("ig_chess_p1", "Grandmaster Simul", s=MIDNIGHT, e=NEXT, all_day=True, food=True), row("ig_chess_p2", "Grandmaster Simul", url="https://forms.gle/simul"), row("ig_chess_p3", "Grandmaster Simul", place=""),
        row("ig_bears_p4", "Pottery Evening", handle="bears", host="Bears"), row("ig_bears_p5", "Pottery Evening", handle="bears", host="Bears", locked=True),
    ]
    known, groups = grouping.plan(listings(spark, rows))
    merged = grouping.survivors(known, groups)
    got = {r.survivor: r for r in merged.collect()}
    assert set(got) == {"ig_chess_p2", "ig_bears_p5"} and got["ig_bears_p5"].locked
    one = got["ig_chess_p2"]
    assert (one.size, one.has_free_food, one.ends_at, one.rsvp_url, one.location, one.hosts) == (3, True, None, "https://forms.gle/simul", "HUB 302", "chess")
    none = spark.createDataFrame([], "event_id string")
    gone = {r.id: (r.survivor, r.why) for r in grouping.replacements(known, groups, merged, none, "2026-09-01 00:00:00").collect()}
    assert gone == {"ig_chess_p1": ("ig_chess_p2", "duplicate"), "ig_chess_p3": ("ig_chess_p2", "duplicate"), "ig_bears_p4": ("ig_bears_p5", "duplicate")}
    tomb = spark.createDataFrame([("ig_bears_p4",)], "event_id string")
    gone = {r.id: r.why for r in grouping.replacements(known, groups, merged, tomb, "2026-09-01 00:00:00").collect()}
    assert gone == {"ig_chess_p1": "duplicate", "ig_chess_p3": "duplicate"}  # the other member of the buried group is locked
    assert grouping.replacements(known, groups, merged, none, "2027-09-01 00:00:00").count() == 0


def test_forced_merges(spark):
    rows = [row("ig_chess_p1", "Grandmaster Simul"), row("ig_bears_p2", "Pottery", place="Barn", handle="bears", host="Bears"), row("ig_x_p3", "Poetry", handle="x", host="X", place="Den")]
    forced = spark.createDataFrame([("ig_bears_p2", "ig_chess_p1"), ("ig_x_p3", "ig_bears_p2")], "old string, new string")
    _, groups = grouping.plan(listings(spark, rows), forced=forced)
    assert {r.group_id for r in groups.collect()} == {"ig_bears_p2"}


def _ids(pairs_found):
    return {(r.l_id, r.r_id) for r in pairs_found.select("l_id", "r_id").collect()}


def test_texts_are_read_once_for_equal_ones(spark, monkeypatch):
    seen = []
    plain = tables.once_each
    monkeypatch.setattr(pairs, "once_each", lambda rows, columns, *layers: seen.append((tuple(columns), rows.select(*columns).distinct().count())) or plain(rows, columns, *layers))
    rows = [row(f"ig_a_p{k}", "Blitz Evening", text="same words" if k % 2 else "others", handle=f"h{k}") for k in range(8)]
    got = pairs.facts(listings(spark, rows)).collect()
    assert {r.id: r.f_account for r in got} == {f"ig_a_p{k}": f"h{k}" for k in range(8)} and all(r.f_title_words == ["blitz", "evening"] for r in got)
    assert dict(seen)[("title",)] == 1 and dict(seen)[("description",)] == 2


def test_pairs_of_one_account_or_credit(spark):
    """Of a busy title's pairs, only those with one account or a credit are made for features of these."""
    rows = [row(f"ig_c{k % 4}_p{k}", "Blitz Evening", handle=f"c{k % 4}", text="with @c3" if k == 4 else "") for k in range(12)]
    known = dedupe.cut(pairs.facts(listings(spark, rows)))
    name = {k: f"ig_c{k % 4}_p{k}" for k in range(12)}
    want = {tuple(sorted((name[a], name[b]))) for a in name for b in name if a < b and (a % 4 == b % 4 or (a == 4 and b % 4 == 3) or (b == 4 and a % 4 == 3))}
    assert _ids(pairs.owned_pairs(known)) == want
    found = pairs.pair_features(pairs.owned_pairs(known.withColumn("f_rarity", F.expr("CAST(map() AS MAP<STRING, DOUBLE>)"))), ("same_account", "credited"), ())
    assert {(r.l_id, r.r_id) for r in found.filter("credited = 1").collect()} == {p for p in want if name[4] in p and p != tuple(sorted((name[0], name[4]))) and p != tuple(sorted((name[4], name[8])))}


def test_matchable_pairs_hold_all_that_rules_join(spark):
    """Pairs that share a title word at other hours aren't compared; every pair that a rule joins is."""
    rows = [r for n, (a, b, _) in enumerate(CASES.values()) for r in (a, b)]
    unique = list({r[0]: r for r in rows}.values())
    busy = [row(f"ig_x{k}_p{900 + k}", "Blitz Evening", s=f"2026-10-05 {10 + k:02d}:00:00", handle=f"x{k}", host=f"X {k}", place=f"Barn {k}") for k in range(12)]
    known = dedupe.cut(pairs.facts(listings(spark, unique + busy)))
    every = pairs.same_event(pairs.candidate_pairs(known))
    tried = _ids(pairs.matchable_pairs(known))
    assert _ids(every.filter("verdict")) <= tried <= _ids(every)
    ours = {r[0] for r in busy}
    assert len([p for p in _ids(every) if set(p) <= ours]) == 66 and not [p for p in tried if set(p) <= ours]


def test_shadow_report(spark):
    """Every upcoming pair of a day that can be compared is scored, but for those that rules join or a person decided; decisions are scored as seen."""
    rows = [
        row("ig_a_p1", "Grandmaster Simul Evening", handle="a", host="A", place="Barn"), row("ig_b_p2", "Grandmaster Simul Dinner", handle="b", host="B", place="HUB 302"), row("ig_c_p3", "Pottery", handle="c", host="C", place="Den"),
        row("ig_d_p4", "Blitz Open Cup", handle="d", host="D"), row("ig_d_p5", "Blitz Open Cup", handle="d", host="D"),
        row("ig_e_p6", "Grandmaster Simul Past", s="2026-09-01 20:00:00", handle="e", host="E"), row("ig_f_p7", "Grandmaster Simul Past", s="2026-09-01 20:00:00", handle="f", host="F"),
    ]
    known = dedupe.cut(pairs.facts(listings(spark, rows)))
    seen = dedupe.cut(pairs.facts(listings(spark, [rows[0], rows[2], rows[3], row("ig_d_p5", "Blitz Open Cup", s="2026-10-09 20:00:00", handle="d", host="D")])))
    reviews = spark.createDataFrame([("ig_c_p3", "ig_a_p1", "different"), ("ig_a_p1", "ig_b_p2", "pending"), ("ig_d_p5", "ig_d_p4", "duplicate"), ("ig_x", "ig_y", "duplicate")], "a string, b string, status string")
    report, totals, decisions = shadow.shadow_report(known, reviews, seen, "2026-10-01 00:00:00")
    assert [(r.l_id, r.r_id, r.queued) for r in report.collect()] == [("ig_a_p1", "ig_b_p2", True)]
    assert [tuple(r) for r in totals.select("scored", "queued").collect()] == [(8, 1)]  # of ten pairs of the day, one is joined and one decided
    assert {(r.status, r.l_id, r.advice, r.score is None) for r in decisions.collect()} == {("different", "ig_a_p1", "dismiss", False), ("duplicate", "ig_d_p4", "not comparable", True)}
