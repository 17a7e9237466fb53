"""Every rule of decisions, occurrences and schedules fails just the row made for it."""

from pyspark.sql import functions as F
from quayside.operators import validation

DECISION = dict(kind="activity", date_role="occurrence", reason="r", activity_evidence="a", date_evidence="d", occurrences=1, has_schedule=False, source_text="")
DECISIONS = [
    ({}, None), ({"kind": "party"}, "unknown decision"), ({"reason": " "}, "unknown decision"), ({"date_role": "cutoff"}, "kind and role disagree"),
    ({"kind": "application", "date_role": "none", "occurrences": 0, "source_text": "Applications due\nOct 14"}, "a dated cutoff is a deadline"), ({"kind": "application", "date_role": "none", "occurrences": 0, "source_text": "Due on a rolling basis"}, None),
    ({"activity_evidence": None}, "no activity evidence"), ({"date_evidence": ""}, "no date evidence"), ({"kind": "application", "date_role": "program_duration", "occurrences": 0, "date_evidence": None}, "no date evidence"),
    ({"occurrences": 101}, "too many occurrences"), ({"has_schedule": True}, "incompatible choices"), ({"kind": "announcement", "date_role": "observance"}, "incompatible choices"), ({"occurrences": 0}, "nothing to publish"),
    ({"kind": "service_schedule", "date_role": "recurring_hours"}, "hours need a schedule"), ({"kind": "deadline", "date_role": "cutoff", "occurrences": 0, "has_schedule": True}, "no schedule of this kind"), ({"kind": "service_schedule", "date_role": "recurring_hours", "occurrences": 0}, None),
]
OCCURRENCE = dict(
    title="Chess Night", all_day=False, s="2026-10-05 19:00:00", e="2026-10-05 21:00:00", start_offset=-420, end_offset=-420, location="HUB 302", location_evidence="HUB 302", activity_evidence="a", date_evidence="Oct 5, 7pm to 9pm",
    posted="2026-09-20 20:00:00", kind="activity", caption="", texts=["Chess Night Oct 5, 7pm to 9pm"], cites_caption=False,
)
ALL_DAY = {"all_day": True, "s": "2026-10-05 00:00:00", "date_evidence": "Oct 5"}
OCCURRENCES = [
    ({}, None), ({"title": " "}, "no title"), ({"location_evidence": None}, "venue not cited"), ({"location": "Barn (implied by the flyer)", "location_evidence": "Barn"}, "venue is reasoning"), ({"location": "", "location_evidence": None}, None),
    ({"activity_evidence": ""}, "no activity evidence"), ({"date_evidence": None}, "no date evidence"), ({"s": None}, "no start"), ({"start_offset": -480}, "offset disagrees"), ({"end_offset": -240}, "offset disagrees"),
    ({"start_offset": -240, "end_offset": -240, "date_evidence": "Oct 5, 7pm ET to 9pm"}, None), ({"e": "2026-10-05 18:00:00"}, "ends before it starts"), ({"e": "2026-10-07 21:00:00"}, "longer than a day"), ({"s": "2026-10-06 19:00:00", "e": None}, "day not supported"),
    ({**ALL_DAY, "e": "2026-10-05 23:59:59"}, None), ({**ALL_DAY, "e": None}, None), ({**ALL_DAY, "s": "2026-10-05 10:00:00", "e": "2026-10-06 00:00:00"}, "no midnight bounds"), ({**ALL_DAY, "e": "2026-10-08 00:00:00"}, "last day not supported"),
    ({**ALL_DAY, "e": "2026-10-08 00:00:00", "date_evidence": "Oct 5 - 7"}, None), ({"s": "2026-10-05 19:30:00"}, "start clock not supported"), ({"e": "2026-10-05 21:30:00"}, "end clock not supported"),
    ({"e": "2026-10-05 00:00:00", "end_offset": -420, "date_evidence": "Oct 5, 7pm-12am"}, None), ({"texts": ["Chess Night Oct 5, 7pm to 9pm", "CRF Chess Night, Oct 5, 8-10pm"]}, "ranges conflict"), ({"texts": ["Chess Night Oct 5, 7pm to 9pm", "Other Night, Oct 5, 8-10pm"]}, None),
    ({"texts": ["Chess Night Oct 5, 8-10pm", "Time update! Chess Night Oct 5, 7pm to 9pm"], "caption": "Time update! Chess Night Oct 5, 7pm to 9pm", "cites_caption": True}, None), ({"kind": "service_schedule", "e": None}, "hours needed"),
]
SCHEDULE = dict(first="2026-10-05", last="2026-10-14", weekdays=[0, 2], windows=[("09:00", "11:00"), ("13:00", "15:00")], date_evidence="Oct 5 to Oct 14, Mon and Wed, 9am-11am and 1pm-3pm", kind="service_schedule")
SCHEDULES = [
    ({}, None), ({"last": "2026-10-04"}, "no bounded range"), ({"last": "2027-10-14"}, "no bounded range"), ({"last": "2026-10-13"}, "no bounded range"), ({"last": None}, "no bounded range"), ({"weekdays": []}, "no weekdays"), ({"weekdays": [0, 7]}, "no weekdays"),
    ({"weekdays": [0]}, "other weekdays than printed"), ({"windows": []}, "windows"), ({"windows": [("09:00", "11:00")] * 5}, "windows"), ({"windows": [("11:00", "09:00")]}, "windows overlap"), ({"windows": [("09:00", "15:00"), ("11:00", "13:00")]}, "windows overlap"),
    ({"windows": [("09:00", "10:00")]}, "window clock not supported"),
]


def errors(spark, base, cases, schema, shape, rules):
    names = [c.split()[0] for c in schema.split(", ")]
    df = spark.createDataFrame([(k, *({**base, **change}[n] for n in names)) for k, (change, _) in enumerate(cases)], f"i int, {schema}")
    got = [r.error for r in validation.judged(shape(df), rules).orderBy("i").collect()]
    return [(change, want, error) for (change, want), error in zip(cases, got, strict=True) if want != error]


def test_decisions(spark):
    schema = "kind string, date_role string, reason string, activity_evidence string, date_evidence string, occurrences int, has_schedule boolean, source_text string"
    assert errors(spark, DECISION, DECISIONS, schema, lambda df: df, validation.decision_rules()) == []


def test_occurrences(spark):
    schema = (
        "title string, all_day boolean, s string, e string, start_offset int, end_offset int, location string, location_evidence string, activity_evidence string, date_evidence string, "
        "posted string, kind string, caption string, texts array<string>, cites_caption boolean"
    )
    ntz = lambda c: F.col(c).cast("timestamp_ntz")
    shape = lambda df: validation.with_read_bounds(df.withColumns({"starts_at": ntz("s"), "ends_at": ntz("e"), "posted_at": ntz("posted")}))
    assert errors(spark, OCCURRENCE, OCCURRENCES, schema, shape, validation.occurrence_rules()) == []


def test_schedules(spark):
    rows = [(k, *({**SCHEDULE, **change}[n] for n in SCHEDULE)) for k, (change, _) in enumerate(SCHEDULES)]
    df = spark.createDataFrame(rows, "i int, first string, last string, weekdays array<int>, windows array<struct<start:string,end:string>>, date_evidence string, kind string")
    df = df.withColumns({"first_day": F.col("first").cast("date"), "last_day": F.col("last").cast("date"), "posted_at": F.lit("2026-09-20 20:00:00").cast("timestamp_ntz")})
    sessions, bad = validation.expanded_schedules(df, "i")
    assert {r.i: r.error for r in bad.collect()} == {k: want for k, (_, want) in enumerate(SCHEDULES) if want}
    got = sorted((str(r.starts_at), str(r.ends_at)) for r in sessions.collect())
    assert got == [(f"2026-10-{d:02d} {a}:00:00", f"2026-10-{d:02d} {b}:00:00") for d in (5, 7, 12, 14) for a, b in ((16, 18), (20, 22))]


def test_schedules_that_say_the_same_are_judged_once(spark, monkeypatch):
    judged, seen = validation.judged, []
    monkeypatch.setattr(validation, "judged", lambda rows, rules: judged(rows, rules) if seen.append(rows.count()) is None else None)
    plain = {**SCHEDULE, "first": "2026-10-05", "last": "2026-10-14"}
    rows = [(k, *({**plain, "weekdays": [0] if k % 3 == 0 else [0, 2]}[n] for n in plain)) for k in range(60)]
    df = spark.createDataFrame(rows, "i int, first string, last string, weekdays array<int>, windows array<struct<start:string,end:string>>, date_evidence string, kind string")
    df = df.withColumns({"first_day": F.col("first").cast("date"), "last_day": F.col("last").cast("date"), "posted_at": F.lit(None).cast("timestamp_ntz")})
    sessions, bad = validation.expanded_schedules(df, "i")
    assert seen == [2]
    assert sorted(r["i"] for r in sessions.collect()) == sorted([k for k in range(60) if k % 3] * 8)
    assert {r.i: r.error for r in bad.collect()} == dict.fromkeys(range(0, 60, 3), "other weekdays than printed")
