"""Scalar functions on hand-written cases."""

import unicodedata
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F
from quayside.functions import classify, texts, times, urls


def one(spark, column, **values):
    names = list(values)
    row = spark.range(1).select(*(F.lit(values[n]).alias(n) for n in names)) if names else spark.range(1)
    return row.select(column.alias("x")).first().x


def ts(text):
    return F.lit(text).cast("timestamp_ntz")


@pytest.mark.parametrize(
    "wall, utc",
    [("2026-03-08 02:30:00", None), ("2026-03-08 03:30:00", "2026-03-08 10:30:00"), ("2026-11-01 01:30:00", "2026-11-01 08:30:00"), ("2026-07-01 00:00:00", "2026-07-01 07:00:00")],
)
def test_wall_clock(spark, wall, utc):
    assert str(one(spark, times.utc_time(ts(wall)))) == str(utc)


def test_three_instant_policies(spark):
    naive, zoned = F.lit("2026-09-15T15:00:00"), F.lit("2026-09-15T15:00:00-07:00")
    assert one(spark, times.strict_instant(naive)) is None
    assert one(spark, times.instant_or_utc(naive)) == datetime(2026, 9, 15, 15)
    assert one(spark, times.instant_or_campus(naive)) == datetime(2026, 9, 15, 22)
    for parse in (times.strict_instant, times.instant_or_utc, times.instant_or_campus):
        assert one(spark, parse(zoned)) == datetime(2026, 9, 15, 22)
        assert one(spark, parse(F.lit("soon"))) is None


def test_deadlines_are_due_at_the_end_of_their_day(spark):
    due = lambda kind, a, b: one(spark, times.sort_at(F.lit(kind), ts(a), ts(b)))
    assert due("student_deadline", "2026-11-01 07:00:00", "2026-11-02 08:00:00") == datetime(2026, 11, 2, 7, 59)
    assert due("student_event", "2026-11-01 07:00:00", "2026-11-02 08:00:00") == datetime(2026, 11, 1, 7)
    assert due("student_deadline", "2026-11-01 09:00:00", "2026-11-02 08:00:00") == datetime(2026, 11, 1, 9)


def test_week_and_relevance(spark):
    assert one(spark, times.week_start(F.lit(date(2026, 11, 27)))) == date(2026, 11, 22)
    midnight = ts("2026-01-02 08:00:00")
    relevant = lambda a, b: one(spark, times.relevance(ts(a), ts(b), midnight))
    assert relevant("2026-01-02 08:00:00", None) is True
    assert relevant("2026-01-01 00:00:00", "2026-01-02 08:00:00") is False
    assert relevant(None, None) is None


def test_urls(spark):
    assert one(spark, urls.http_url(F.lit("example.com/a"))) == "https://example.com/a"
    assert one(spark, urls.http_url(F.lit("//example.com/a"))) == "https://example.com/a"
    assert one(spark, urls.http_url(F.lit("ftp://example.com"))) is None
    assert one(spark, urls.rsvp_identity(F.lit("HTTPS://WWW.Example.com/a/?utm_source=x&b=2&a=1"))) == "example.com/a?a=1&b=2"
    assert one(spark, urls.rsvp_identity(F.lit("https://example.com/"))) is None
    assert one(spark, urls.media_key(F.lit("https://cdn.example.com/x/123_n.jpg?sig=1"))) == "123_n"
    assert one(spark, urls.shortcode_to_media_id(F.lit("BA")).cast("long")) == 64
    assert str(one(spark, urls.shortcode_to_media_id(F.lit("DPx9zzzzzzz")))) == str(int(sum("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_".index(c) * 64**i for i, c in enumerate("DPx9zzzzzzz"[::-1]))))


def test_texts(spark):
    assert one(spark, texts.word_shingles(F.lit("a b c a b c"), 3)) == ["a b c", "b c a", "c a b"]
    assert one(spark, texts.word_shingles(F.lit("a b"), 3)) == [] and one(spark, texts.char_grams(F.lit("ab"))) == []
    assert one(spark, texts.char_grams(F.lit("abcd"))) == ["abc", "bcd"]
    assert one(spark, texts.mentions(F.lit("with @Club.A. and @b_c"))) == ["club.a", "b_c"]
    assert one(spark, texts.byline(F.array(F.lit("A"), F.lit("B"), F.lit("C")))) == "A, B & C"
    assert one(spark, texts.fold_accents(F.lit("résumé ﬁ"))) == "resume fi"
    assert one(spark, texts.decode_text(F.lit("a &amp;amp; b \\u00e9 – x"))) == "a & b é - x"
    assert one(spark, texts.tri_state(F.lit(" Yes "))) is True and one(spark, texts.tri_state(F.lit("maybe"))) is None
    assert one(spark, texts.calendar_text(F.lit("a,b;c\\d\ne"))) == "a\\,b\\;c\\\\d\\ne"
    folded = one(spark, texts.fold_calendar_line(F.lit("é" * 100)))
    assert all(len(line.encode()) <= 75 for line in folded.split("\r\n")) and folded.replace("\r\n ", "") == "é" * 100


def test_categories(spark):
    of = lambda title, text="", host="none": one(spark, classify.category(F.lit(title), F.lit(text), F.lit(host)))
    assert of("Boba Social") == "hangout" and of("Volleyball Tournament") == "sports" and of("State-of-the-art things") == "other"
    assert of("Lumberjack Classic", "a volleyball match") == "other" and of("Lumberjack Classic", "a volleyball match", "athletics") == "sports"
    assert of("Career dance") == "arts"


def test_kinds(spark):
    of = lambda title, text="", origin="instagram", assessed=None: one(spark, classify.content_kind(F.lit(origin), F.lit(title), F.lit(text), F.lit(assessed).cast("string")))
    assert of("Bake Sale", "proceeds help us") == "fundraiser"
    assert of("Apply to be our fundraising chair") == "student_event"
    assert of("Blood drive", "blood donations welcome") == "student_event"
    assert of("Paper due by Friday deadline") == "student_deadline"
    assert of("Summer Fellowship", "Applications are now open for the program") == "student_application"
    assert of("Fellowship info session", "Applications are now open for the program") == "student_event"
    assert of("Gala", "black tie", "campus_website") == "other" and of("Gala", "all students welcome", "campus_website") == "student_event"
    assert of("Anything", assessed="uncertain") == "other" and of("Library closed") == "other"
    assert of("Modified hours for finals") == "other" and of("Closed mic concert") == "student_event"
    assert of("Suicide Prevention Month", "Know the signs") == "other" and of("Prevention Week", "Join our workshop at 5 pm") == "student_event"
    assert of("Breast Cancer Awareness Month", "donate today") == "fundraiser"
    assert of("Peer mentors", "Book your slot for a coffee chat") == "student_application" and of("Office hours", "Book your slot for a coffee chat") == "student_event"
    assert of("10 Year Anniversary", "7-week in-person summer program") == "student_event" and of("Build", "7-week in-person summer program") == "student_application"
    assert of("Gala", "open to all current students", "campus_website") == "student_event" and of("Blood drive", "donations for citations") == "student_event"
    printed = classify.content_kind(F.lit("instagram"), F.lit("Water balloons"), F.lit("for a good cause"), F.lit(None).cast("string"), printed=F.lit("$1.50 each"))
    assert one(spark, printed) == "fundraiser" and of("Water balloons", "for a good cause") == "student_event"


def test_folding(spark):
    for text in ("Café Ñandú", "𝐁𝐨𝐛𝐚 𝓝𝓲𝓰𝓱𝓽", "Ａｂｃ", "e\u0301te\u0301", "plain"):
        want = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
        assert one(spark, texts.folded(F.lit(text))) == want == one(spark, texts.fold_accents(F.lit(text)))


def test_templates_ignore_ordinals(spark):
    long = " of the yearly gathering of all the friends of the old observatory and its many keepers"
    assert one(spark, texts.caption_template(F.lit("May 1st" + long))) == one(spark, texts.caption_template(F.lit("June 22nd" + long)))


@pytest.mark.parametrize(
    "text, free",
    [("free pizza!", True), ("no pizza, but free tacos", True), ("lunch for sale", False), ("dinner included", True), ("tickets $5, dinner included", False), ("free admission; boba", False), ("pizza is not provided", False)],
)
def test_free_food(spark, text, free):
    assert one(spark, classify.free_food(F.lit(text))) is free


def test_sun(spark):
    from quayside.functions.daylight import daypart, solar_elevation

    rows = spark.sql("SELECT TIMESTAMP_NTZ '2026-06-21 19:50:00' AS t UNION ALL SELECT TIMESTAMP_NTZ '2026-06-21 08:00:00' UNION ALL SELECT CAST(NULL AS TIMESTAMP_NTZ)")
    noon, night, none = rows.select(solar_elevation(F.col("t")).alias("e")).select("e", daypart(F.col("e")).alias("p")).collect()
    assert abs(noon.e - (90 - 33.9737 + 23.44)) < 0.1 and noon.p == "day"  # highest at the June solstice
    assert night.e < -25 and night.p == "night" and none.e is None and none.p is None
