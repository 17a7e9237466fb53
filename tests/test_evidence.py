"""Printed dates, ranges and clocks, grounding, and session texts, on hand-written posts."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from quayside.functions import evidence
from quayside.operators import sessions

# text, the days that it pins down as month * 100 + day
TEXTS = [
    ("Oct 5 at 7pm", [1005]), ("Sept. 12th and OET 6", [912, 1006]), ("31 of January, 2nd Feb", [131, 202]), ("Feb 30", []), ("5월 8일", [508]), ("2025년 12월 3일", [1203]), ("12/25/2025", [1225]), ("2026-05-28", [528]),
    ("12\n25\n2026\nMONTH DAY YEAR", [1225]), ("11 07\n26\nMonth  Day  Year", [1107]), ("x 11 07 26 MONTH DAY YEAR", []), ("score 3/4", []), ("on 3/4 we meet", [304]), ("3/4 at 7pm", [304]), ("room 3/4 at 7pm", []),
    ("1/2 cups of milk at noon", []), ("1/2 of it at noon", []), ("1/2\nof milk at 7pm", []), ("Psychology TUESDAY 11/17\nof gratitude", [1117]), ("on 5.62", []), ("5.28 at 8:30", [528]), ("recruitment is 10/8-10/11", [1008, 1011]),
    ("10/8 to 14/40", []), ("Fall Recruitment 10/5", [1005]), ("applications are due: 10/9", [1009]), ("GENERAL MEETING SCHEDULE\n10/5\n10/12", [1005, 1012]), ("EVENTS\n10/5\n10/12", []), ("signups close Thursday (6/11)", [611]),
    ("6/11, Thursday", [611]), ("Happy Friday! 1/2 price boba", []), ("Friday is here for 1/2", []), ("1-2 pm", []), ("$5/28 on 5/28/", []), ("by 13/1", []), ("", []),
]
RANGES = [
    ("11-3PM", "11:00-15:00"), ("1-3PM", "13:00-15:00"), ("10-12PM", "10:00-12:00"), ("11-1AM", "23:00-01:00"), ("1:30pm - 3 p.m. today", "13:30-15:00"), ("5PM 7PM", "17:00-19:00"), ("12am to 1:05 am", "00:00-01:05"),
    ("1-3PM or 2-4PM", None), ("13-15pm", None), ("5pm", None), ("3:70-4pm", None), ("", None),
]


def column(spark, rows, expression):
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, text string, want string")
    return [r.x for r in df.withColumn("x", expression).orderBy("k").collect()]


def test_days(spark):
    got = column(spark, [(t, None) for t, _ in TEXTS], evidence.evidence_days(F.col("text")))
    assert dict(zip((t for t, _ in TEXTS), got, strict=True)) == dict(TEXTS)


def test_spans_of_dates(spark):
    text = "See you Oct 5, or 10/12 at 3PM"
    (got,) = column(spark, [(text, None)], evidence.printed_dates(F.col("text")))
    assert [(d.form, text[d.start : d.end]) for d in got] == [("month_name", "Oct 5"), ("bare", "10/12")]


def test_ranges(spark):
    got = column(spark, [(t, None) for t, _ in RANGES], evidence.time_range(F.col("text")))
    assert dict(zip((t for t, _ in RANGES), got, strict=True)) == dict(RANGES)


@pytest.mark.parametrize(
    "text, days",
    [
        ("Fri, Oct 2 - Sun, Oct 4", [(date(2026, 10, 2 + k), False) for k in range(3)]), ("Friday Oct 2, 2026 through Saturday Oct. 3rd", [(date(2026, 10, 2 + k), True) for k in range(2)]), ("Thu, Oct 2 - Sun, Oct 4", []),
        ("Fri, Oct 2 - Sun, Oct 11", []), ("Fri, Oct 2 - Sat, Feb 30", []), ("Thu Dec 31 - Fri Jan 1", []), ("Fri, Oct 2", []),
    ],
)
def test_weekday_ranges(spark, text, days):
    (got,) = column(spark, [(text, None)], evidence.weekday_range_days(F.col("text"), F.lit(2026)))
    assert [(d.day, d.printed) for d in got] == days


def test_midnight_ends(spark):
    start, wrong, right = "2026-10-03 03:00:00", "2026-10-02 07:00:00", datetime(2026, 10, 3, 7)
    ntz = lambda t: F.lit(t).cast("timestamp_ntz")
    texts = ["Oct 2, 8PM-12AM", "October 2, 2026 8pm to 12am", "Oct 2, 2025 8PM-12AM", "Oct 2 or Oct 3, 8PM-12AM", "Oct 2, 8PM-11PM", "8PM-12AM"]
    got = column(spark, [(t, None) for t in texts], evidence.midnight_end(F.col("text"), ntz(start), ntz(wrong)))
    assert [g == right for g in got] == [True, True, False, False, False, False]


def test_grounding(spark):
    cases = [("5", "costs $5", False), ("5", "5 people", True), ("a+b", "so a+b.", True), ("art", "party", False), ("x\\E", "x\\E y", True), ("", "x", False), (None, "x", False), ("né", "née", False)]
    df = spark.createDataFrame([(k, q, t) for k, (q, t, _) in enumerate(cases)], "k int, q string, t string")
    assert [r.x for r in df.withColumn("x", evidence.grounded(F.col("q"), F.col("t"))).orderBy("k").collect()] == [w for *_, w in cases]


def sliced(spark, fields, occurrences):
    f = spark.createDataFrame([("s", name, k, text) for k, (name, text) in enumerate(fields.items())], "source_key string, field string, position int, text string")
    o = spark.createDataFrame([("s", k, *o) for k, o in enumerate(occurrences)], "source_key string, occurrence int, title string, s string, fields array<string>")
    o = o.withColumn("starts_at", F.col("s").cast("timestamp_ntz")).drop("s")
    return [r.text for r in sessions.session_texts(f, o).orderBy("occurrence").collect()]


DAY1, DAY2 = "2026-10-05 20:00:00", "2026-10-12 20:00:00"


def test_session_texts(spark):
    caption = "Welcome!\nOct 5: pizza\nand games\nOct 12: tacos\nRegister by Friday\nBlitz Night: bring a friend"
    both = [("Pizza Day", DAY1, ["caption"]), ("Blitz Night", DAY2, ["caption"])]
    assert sliced(spark, {"caption": caption}, both) == ["Register by Friday\nOct 5: pizza\nand games", "Register by Friday\nOct 12: tacos\nRegister by Friday\nBlitz Night: bring a friend"]
    # one title: everything; a field of one session: whole; no anchor: nothing
    assert sliced(spark, {"caption": "a", "slide_1_ocr": "b"}, [("Same", DAY1, ["caption"]), ("Same", DAY2, [])]) == ["a\nb", "a\nb"]
    assert sliced(spark, {"caption": "all of it", "slide_1_ocr": "mine"}, [("Zeta", DAY1, ["slide_1_ocr", "caption"]), ("Beta", DAY2, ["caption"])]) == ["mine", ""]
    # two sessions of a day: the date alone names neither
    assert sliced(spark, {"caption": "Oct 5 morning\nAlpha here"}, [("Alpha", DAY1, ["caption"]), ("Beta", DAY1, ["caption"])]) == ["Alpha here", ""]
    sale = "Alpha is fun\n\nOur bake sale helps\n\nAlpha and a bake sale\nfree pizza"
    assert sliced(spark, {"caption": sale}, [("Alpha", DAY1, ["caption"]), ("Bake Sale", DAY2, [])]) == ["Alpha is fun\n\nfree pizza", ""]
    assert sliced(spark, {"caption": None}, [("A", DAY1, ["caption"]), ("B", DAY2, None)]) == ["", ""]
