"""Days, clocks and zones that texts bear out, on hand-written posts."""

from pyspark.sql import functions as F
from quayside.functions import support

# text, the day claimed, when it was posted (UTC), whether it is a lineup of a week, and whether the day is borne out
DAYS = [
    ("Oct 5", "2026-10-05", "2026-09-20", False, True), ("Oct 5", "2027-10-05", "2026-09-20", False, False), ("Oct 5", "2026-10-05", None, False, True), ("Oct 5", "2026-10-06", "2026-09-20", False, False),
    ("Oct 5, 2026", "2026-10-05", "2020-01-01", False, True), ("Oct 5, 2025", "2026-10-05", "2026-09-20", False, False), ("10/5/2026", "2026-10-05", None, False, True), ("10/5/2025", "2026-10-05", None, False, False),
    ("2026-10-05", "2026-10-05", None, False, True), ("May 27", "2026-05-27", "2026-05-26", False, True), ("May 27", "2027-05-27", "2026-05-26", False, False), ("Opened May 27", "2026-05-27", "2026-06-10", False, True),
    ("Jan 3", "2027-01-03", "2026-12-20", False, True), ("since 1962, Oct 5", "2026-10-05", "2026-10-01", False, True), ("Oct 2 - 5", "2026-10-05", "2026-09-20", False, True), ("Oct 2 - 5", "2026-10-02", "2026-09-20", False, True),
    ("Oct 2 - 5", "2026-10-03", "2026-09-20", False, False), ("Oct 2 - 5\nDay 2: Robots", "2026-10-03", "2026-09-20", False, True), ("Oct 2 - 5, 2025", "2026-10-05", "2026-09-20", False, False), ("Oct 2 through the 5th, 2026", "2026-10-02", None, False, True),
    ("Fri, Oct 2 - Sun, Oct 4", "2026-10-03", "2026-09-20", False, True), ("Fri, Oct 2, 2026 - Sun, Oct 4", "2026-10-03", "2020-01-01", False, True), ("12\n25\n26\nMONTH DAY YEAR", "2026-12-25", "2020-01-01", False, True),
    ("2025년 10월 5일", "2026-10-05", "2026-09-20", False, False), ("see you today", "2026-10-05", "2026-10-05 20:00:00", False, True), ("see you today", "2026-10-05", "2026-10-06 03:00:00", False, True), ("TONIGHT", "2026-10-06", "2026-10-05 20:00:00", False, False),
    ("tomorrow!", "2026-10-06", "2026-10-05 20:00:00", False, True), ("this Friday", "2026-10-09", "2026-10-05 20:00:00", False, True), ("this coming mon", "2026-10-05", "2026-10-05 20:00:00", False, True), ("next Friday", "2026-10-09", "2026-10-05 20:00:00", False, False),
    ("this Friday", "2026-10-09", None, False, False), ("this week: Tue and Thu", "2026-10-08", "2026-10-05 20:00:00", True, True), ("this week: Tue and Thu", "2026-10-08", "2026-10-05 20:00:00", False, False),
    ("this week: Tue and Thu", "2026-10-07", "2026-10-05 20:00:00", True, False), ("this week: Tue to Thu", "2026-10-07", "2026-10-05 20:00:00", True, True), ("routes for the week, daily", "2026-10-10", "2026-10-04 20:00:00", True, True),
    ("this week of Oct: Tue", "2026-10-06", "2026-10-05 20:00:00", True, False), ("next week on Tuesday. Every Monday", "2026-10-13", "2026-10-05 20:00:00", True, True), ("next week on Tuesday. Every Monday", "2026-10-12", "2026-10-05 20:00:00", True, False),
    ("Oct 5 or today", "2026-10-05", "2020-10-05 20:00:00", False, False), ("", "2026-10-05", "2026-10-05", False, False), (None, "2026-10-05", "2026-10-05", False, False),
]
CLOCKS = [
    ("5pm", [1020]), ("5:30 p.m. and 9 a", [540, 1050]), ("11-3PM", [660, 900]), ("1-3pm", [780, 900]), ("at 17:05", [1025]), ("noon to midnight", [0, 720]), ("5PM 7PM", [1020, 1140]), ("13pm", []), ("12am", [0]), ("8:15pm", [1215]), ("", []),
]
ZONES = [
    ("5pm ET", ["America/New_York"]), ("17:00 UTC", ["+00:00"]), ("5 pm (EST)", ["-05:00", "America/New_York"]), ("Eastern Time", ["America/New_York"]), ("central daylight time", ["America/Chicago"]), ("Mt. Hill, EST. 2009", []), ("5pm", []),
]


def test_days(spark):
    df = spark.createDataFrame([(k, t, d, p, w) for k, (t, d, p, w, _) in enumerate(DAYS)], "k int, text string, d string, p string, w boolean")
    day, posted = F.col("d").cast("date"), F.col("p").cast("timestamp_ntz")
    got = [r.x for r in df.withColumn("x", support.day_supported(day, F.col("text"), posted, F.col("w"))).orderBy("k").collect()]
    assert [(*case[:4], x) for case, x in zip(DAYS, got, strict=True) if x != case[4]] == []


def test_clocks_and_zones(spark):
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(CLOCKS + ZONES)], "k int, text string")
    rows = df.withColumns({"clocks": support.printed_clocks(F.col("text")), "zones": support.named_zones(F.col("text"))}).orderBy("k").collect()
    assert [(r.text, r.clocks) for r in rows[: len(CLOCKS)]] == CLOCKS
    assert [(r.text, r.zones) for r in rows[len(CLOCKS) :]] == ZONES
    at = F.lit("2026-10-05 15:00:00").cast("timestamp_ntz")
    assert [r.x for r in df.filter("k IN (2, 4)").orderBy("k").withColumn("x", support.clock_supported(at, F.col("text"))).collect()] == [True, False]
