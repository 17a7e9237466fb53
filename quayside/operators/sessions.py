"""What a post that lists several sessions says of each: its text cut at printed dates and named sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import times
from ..functions.evidence import scanned_dates

# A line that tells how to register for all sessions, a call for funds, and line ends.
SHARED_LINE = r"(?i)^\s*(?:please\s+)?(?:register|rsvp|sign[- ]?up)\s+(?:by|before|here|now|through|via|using|at)\b"
FUNDRAISING, SALE = r"(?i)fundrais|\b(?:food|bake) sale\b", r"(?i)fundrais|\bsale\b"
LINE_END, PARAGRAPH = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", r"\n\s*\n"


def plain(text: Column) -> Column:
    """Lower case, a space for whatever is no letter or digit."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\W+", " "))


def session_texts(fields: DataFrame, occurrences: DataFrame) -> DataFrame:
    """source_key, occurrence, text: the lines that are evidence for each session.

    fields: source_key, field, position, text; occurrences: source_key, occurrence, title, starts_at
    (UTC), fields (those that it cites).  A post with one title has all its text.  Of several, a session
    gets the fields it cites: whole, where sessions of no other title cite it; else cut into lines.
    A line with dates or session names is an anchor, which belongs to the session that it names, or
    whose day it prints if that day has one session; a slice runs from an anchor to the next.  A field
    that no anchor cuts supplies nothing, but for lines on registering that name no session.  In a
    caption, a sibling's fundraiser is left out.  Null texts are empty; no fields: an empty text.
    """
    local = times.campus_time(F.col("starts_at"))
    told = occurrences.withColumns({"own": plain(F.coalesce("title", F.lit(""))), "day": F.to_date(local), "number": F.month(local) * 100 + F.dayofmonth(local)})
    per_day = told.groupBy("source_key", "day").agg(F.count("*").alias("same_day"))
    posts = told.groupBy("source_key").agg(F.count_distinct("title").alias("titles"), F.count("*").alias("sessions"), F.array_sort(F.collect_set(F.when(F.col("own") != "", F.col("own")))).alias("names"))
    told = told.join(per_day, ["source_key", "day"], "left").join(posts.select("source_key", "titles", "sessions"), "source_key")
    texts = fields.select("source_key", "field", "position", F.coalesce("text", F.lit("")).alias("text"))
    whole = texts.groupBy("source_key").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "field", "text"))), lambda f: f["text"]), "\n").alias("text"))
    single = told.filter("titles < 2").join(whole, "source_key", "left").select("source_key", "occurrence", F.coalesce("text", F.lit("")).alias("text"))

    several = told.filter("titles >= 2")
    cited = several.select("source_key", "occurrence", "title", "own", "number", "same_day", "sessions", F.explode(F.array_distinct("fields")).alias("field"))
    users = cited.groupBy("source_key", "field").agg(F.count_distinct("title").alias("users"))
    cited = cited.join(users, ["source_key", "field"]).join(texts, ["source_key", "field"])
    apart = (F.col("field") == "caption") & (F.col("sessions") > 1) & ~F.col("title").rlike(SALE) & F.col("text").rlike(FUNDRAISING)
    cited = cited.withColumn("apart", F.coalesce(apart, F.lit(False)))

    own_paragraphs = F.filter(F.split("text", PARAGRAPH), lambda p: ~p.rlike(FUNDRAISING) | F.contains(plain(p), F.col("own")))
    own_lines = lambda p: F.array_join(F.filter(F.split(p, LINE_END), lambda line: ~line.rlike(FUNDRAISING)), "\n")
    kept = F.when(F.col("apart"), F.array_join(F.transform(own_paragraphs, own_lines), "\n\n")).otherwise(F.col("text"))
    alone = cited.filter("users = 1").select("source_key", "occurrence", "field", F.lit(0).alias("turn"), F.lit(0).alias("line"), kept.alias("said"))

    # lines once per field, with what they print, then per session that cites the field
    shared = texts.join(users.filter("users > 1").select("source_key", "field"), ["source_key", "field"], "left_semi").join(posts.select("source_key", "names"), "source_key")
    lines = shared.select("source_key", "field", "names", F.posexplode(F.split("text", LINE_END)).alias("line", "said"))
    lines = lines.select(
        "source_key", "field", "line", "said",
        F.array_distinct(F.transform(scanned_dates(F.col("said")), lambda d: d["month"] * 100 + d["day"])).alias("dates"),
        F.filter("names", lambda n: F.contains(plain(F.col("said")), n)).alias("named"),
    )
    mine = cited.filter("users > 1").select("source_key", "occurrence", "field", "own", "number", "same_day", "apart").join(lines, ["source_key", "field"])
    other_sale = F.col("apart") & F.col("said").rlike(FUNDRAISING)
    anchor = (F.size("dates") > 0) | (F.size("named") > 0) | other_sale
    by_name, by_day = F.col("named") == F.array("own"), (F.col("dates") == F.array("number")) & (F.col("same_day") == 1)
    belongs = ~other_sale & F.when(F.size("named") > 0, by_name).otherwise(by_day)
    reached = Window.partitionBy("source_key", "occurrence", "field").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = mine.withColumn("held", F.coalesce(F.last(F.when(anchor, belongs), ignorenulls=True).over(reached), F.lit(False)))
    slices = held.filter("held").select("source_key", "occurrence", "field", F.lit(1).alias("turn"), "line", "said")
    common = mine.filter(F.col("said").rlike(SHARED_LINE) & (F.size("named") == 0)).select("source_key", "occurrence", "field", F.lit(0).alias("turn"), "line", "said")

    parts = alone.unionByName(slices).unionByName(common)
    joined = parts.groupBy("source_key", "occurrence").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("field", "turn", "line", "said"))), lambda p: p["said"]), "\n").alias("text"))
    cut_up = several.select("source_key", "occurrence").join(joined, ["source_key", "occurrence"], "left").select("source_key", "occurrence", F.coalesce("text", F.lit("")).alias("text"))
    return single.unionByName(cut_up)
