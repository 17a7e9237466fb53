"""Finding repeated listings: best rows, tombstones, blocked pairs, word rarity, components and decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts
from ..sources.tables import cut, spread


def event_key() -> Column:
    """Account, title and minute: equal for what is surely one event; null where any is missing."""
    title, minute = texts.normal_title(F.col("title")), F.date_format("starts_at", "yyyyMMdd'T'HHmm'Z'")
    account = F.when(F.col("id").startswith("ig_"), F.concat(F.regexp_replace("id", "_[^_]*$", ""), F.lit("|")))
    usable = (title != "") & F.col("starts_at").isNotNull()
    return F.when(usable & (account.isNotNull() | (F.col("source") != "instagram")), F.concat(F.coalesce(account, F.lit("")), title, F.lit("|"), minute))


def row_score() -> Column:
    """What makes a row the better of two."""
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return F.struct(
        flag(F.col("has_free_food")), flag(F.col("source") != "instagram"), flag(F.trim("host") != ""), flag(F.col("rsvp_url").isNotNull()), F.length(F.coalesce("description", F.lit(""))), F.col("id")
    )


def best_rows(rows: DataFrame, position: str) -> DataFrame:
    """The best row of each id, then of each event key; of equal ones the last by position.  Rows without a key stay."""
    by_id = Window.partitionBy("id").orderBy(row_score().desc(), F.desc(position))
    once = rows.withColumn("n", F.row_number().over(by_id)).filter("n = 1").withColumn("key", F.coalesce(event_key(), F.concat(F.lit("#"), "id")))
    by_key = Window.partitionBy("key").orderBy(row_score().desc(), F.desc(position))
    return once.withColumn("n", F.row_number().over(by_key)).filter("n = 1").drop("n", "key")


def without_deleted(rows: DataFrame, deleted: DataFrame) -> DataFrame:
    """Rows that no tombstone names, by id or by the key of a deleted row; locked rows stay."""
    gone = deleted.select(F.col("event_id").alias("id"))
    keys = rows.join(gone, "id", "left_semi").select(event_key().alias("key")).filter("key IS NOT NULL").distinct()
    keyed = rows.withColumn("key", event_key())
    named = keyed.join(gone.withColumn("g", F.lit(True)), "id", "left").join(keys.withColumn("h", F.lit(True)), "key", "left")
    return named.filter("is_locked OR (g IS NULL AND h IS NULL)").drop("key", "g", "h")


def _side(rows: DataFrame, prefix: str, *keys: str) -> DataFrame:
    return rows.select(*keys, *(F.col(c).alias(f"{prefix}_{c}") for c in rows.columns if c not in keys))


def blocked_pairs(rows: DataFrame) -> DataFrame:
    """Pairs of one kind on one campus day, the smaller id left; rows of kind other take no part.

    An equi join on (kind, day): shuffled by day, and AQE splits a busy day.
    """
    live = rows.filter("content_kind <> 'other'")
    return _side(live, "l", "content_kind", "day").join(_side(live, "r", "content_kind", "day"), ["content_kind", "day"]).filter("l_id < r_id")


def deadline_band(rows: DataFrame, days: int = 32) -> DataFrame:
    """Pairs of deadlines of one account within `days` days: an equi join on account and bin, each row also in the bin before."""
    due = rows.filter("content_kind = 'student_deadline'").withColumn("number", F.datediff("day", F.lit("1970-01-01").cast("date")))
    own = F.floor(F.col("number") / days)
    left = _side(due.withColumn("bin", F.explode(F.array(own, own + 1, own - 1))), "l", "host_handle", "bin")
    right = _side(due.withColumn("bin", own), "r", "host_handle", "bin")
    return left.join(right, ["host_handle", "bin"]).filter((F.col("l_id") < F.col("r_id")) & (F.abs(F.col("l_number") - F.col("r_number")) <= days))


def blocked_pair_counts(rows: DataFrame) -> DataFrame:
    """How many pairs each kind and day has, without making one."""
    counted = rows.filter("content_kind <> 'other'").groupBy("content_kind", "day").agg(F.count("*").alias("n"))
    return counted.filter("n > 1").select("content_kind", "day", F.expr("n * (n - 1) DIV 2").alias("pairs"))


def close_starts(rows: DataFrame, key: list[str], seconds: int = 900) -> DataFrame:
    """Pairs with equal keys that start up to `seconds` apart, but not at once: an equi join on key and bin, each row also in the bins beside its own."""
    timed = rows.withColumn("second", F.unix_timestamp(F.col("starts_at").cast("timestamp")))
    own = F.floor(F.col("second") / seconds)
    left = _side(timed.withColumn("bin", F.explode(F.array(own - 1, own, own + 1))), "l", *key, "bin")
    right = _side(timed.withColumn("bin", own), "r", *key, "bin")
    return left.join(right, [*key, "bin"]).withColumn("gap", F.abs(F.col("l_second") - F.col("r_second"))).filter((F.col("l_id") < F.col("r_id")) & F.col("gap").between(1, seconds))


def review_pairs(rows: DataFrame, least: int = 2) -> DataFrame:
    """Pairs for a person to look at: one kind and day, the later starts before the earlier ends, `least` title words in common.

    Titles are compared as the word sets that a day has, once each; listings then meet by the sets that go
    together.  Nothing is kept or sorted but listings with such a set, so what is shuffled doesn't grow with
    the pairs.  Sets meet by a word of their day: of two with `least` words in common one is shared besides
    the least - 1 most used words of either, so those are no keys.
    """
    day = ["content_kind", "day"]
    live = rows.filter("content_kind <> 'other'").withColumn("words", F.array_sort(texts.words(F.col("title")))).withColumn("set", F.array_join("words", " "))
    sets = cut(live.select(*day, "set", "words").distinct())
    named = sets.select(*day, "set", F.explode("words").alias("word"))
    used = named.groupBy(*day, "word").agg(F.count("*").alias("n"))
    ranked = named.join(used, [*day, "word"]).withColumn("rank", F.row_number().over(Window.partitionBy(*day, "set").orderBy(F.desc("n"), "word")))
    keys = ranked.filter(F.col("rank") >= least).select(*day, "set", "word")
    met = keys.withColumnRenamed("set", "l_set").join(keys.withColumnRenamed("set", "r_set"), [*day, "word"]).select(*day, "l_set", "r_set").distinct()
    both = met.join(sets.select(*day, F.col("set").alias("l_set"), F.col("words").alias("l_words")), [*day, "l_set"]).join(sets.select(*day, F.col("set").alias("r_set"), F.col("words").alias("r_words")), [*day, "r_set"])
    alike = cut(both.select(*day, "l_set", "r_set", F.size(F.array_intersect("l_words", "r_words")).alias("common")).filter(F.col("common") >= least))
    left, right = (_side(live.drop("words"), end, *day) for end in "lr")
    ends = F.coalesce("l_ends_at", "l_starts_at"), F.coalesce("r_ends_at", "r_starts_at")
    overlap = (F.col("l_starts_at") <= ends[1]) & (F.col("r_starts_at") <= ends[0])
    return left.join(alike, [*day, "l_set"]).join(right, [*day, "r_set"]).filter((F.col("l_id") < F.col("r_id")) & overlap)


def shingle_classes(rows: DataFrame, key: str, text: str, words: int = 3) -> DataFrame:
    """key, shingles (hashes, sorted), class: the smallest key of those with equal shingle sets; rows without shingles are left out."""
    sets = spread(rows).select(key, F.array_sort(F.transform(texts.word_shingles(F.col(text), words), lambda s: F.xxhash64(s))).alias("shingles")).filter(F.size("shingles") > 0)
    firsts = sets.groupBy("shingles").agg(F.min(key).alias("class"))
    return sets.join(firsts, "shingles")


def shingle_pairs(classes: DataFrame, key: str, least: int = 20, often: int = 1000) -> DataFrame:
    """a, b, common: pairs of class representatives with `least` shingles or more in common, all of them.

    Shingles of up to `often` texts are counted pair by pair in one aggregation, which makes `often`
    rows for each of them at most.  Those of more texts are no keys as such: each text keeps its list of
    them, which is met with the other's.  Pairs that share nothing else are found by an exact prefix
    filter: of two texts with `least` of them in common one is shared besides the least - 1 most
    frequent ones of either.
    """
    sets = classes.filter(F.col(key) == F.col("class")).select("class", "shingles")
    each = sets.select("class", F.explode("shingles").alias("shingle"))
    used = cut(each.groupBy("shingle").agg(F.count("*").alias("n")).filter("n > 1"))
    found = cut(each.join(used, "shingle"))
    two = lambda keys: keys.withColumnRenamed("class", "a").join(keys.withColumnRenamed("class", "b"), "shingle").filter("a < b")
    counted = two(found.filter(F.col("n") <= often).select("class", "shingle")).groupBy("a", "b").agg(F.count("*").alias("rare"))
    common_ones = found.filter(F.col("n") > often)
    lists = cut(common_ones.groupBy("class").agg(F.array_sort(F.collect_list("shingle")).alias("usual")))
    ranked = common_ones.withColumn("rank", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("n"), "shingle")))
    usual = two(ranked.filter(F.col("rank") >= least).select("class", "shingle")).select("a", "b").distinct()
    pairs = counted.join(usual.withColumn("usual", F.lit(True)), ["a", "b"], "full").select("a", "b", F.coalesce("rare", F.lit(0)).alias("rare"))
    side = lambda end: lists.select(F.col("class").alias(end), F.col("usual").alias(f"of_{end}"))
    none = F.array().cast("array<bigint>")
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    shared = F.size(F.array_intersect(F.coalesce("of_a", none), F.coalesce("of_b", none)))
    return both.select("a", "b", (F.col("rare") + shared).cast("long").alias("common")).filter(F.col("common") >= least)


def word_rarity(rows: DataFrame) -> DataFrame:
    """word, accounts, rarity = ln((all accounts + 1) / (accounts that use it + 1))."""
    used = rows.select("host_handle", F.explode(texts.words(F.col("title"))).alias("word")).distinct().groupBy("word").agg(F.count("*").alias("accounts"))
    total = rows.agg(F.countDistinct("host_handle").alias("total"))
    return used.crossJoin(F.broadcast(total)).select("word", "accounts", F.log((F.col("total") + 1) / (F.col("accounts") + 1)).alias("rarity"))  # total is one row


def components(edges: DataFrame) -> DataFrame:
    """node, root by contraction: nodes point at their smallest neighbour, pointers double until none
    moves, and edges move to what is pointed at."""
    left = cut(edges.select("a", "b").filter("a <> b").distinct())
    mapped: list[DataFrame] = []
    while left.limit(1).count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent, moving = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("p"))), 1
        while moving:
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("x"))
            followed = cut(parent.join(up, "p").select("node", F.col("x").alias("p"), (F.col("p") != F.col("x")).alias("moved")))
            moving, parent = followed.filter("moved").limit(1).count(), followed.select("node", "p")
        mapped.append(parent)
        moved = left.join(parent.select(F.col("node").alias("a"), F.col("p").alias("x")), "a").join(parent.select(F.col("node").alias("b"), F.col("p").alias("y")), "b")
        left = cut(moved.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if not mapped:
        return edges.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0)
    roots = mapped[-1].select("node", F.col("p").alias("root"))
    for parent in reversed(mapped[:-1]):
        roots = parent.join(roots.select(F.col("node").alias("p"), "root"), "p", "left").select("node", F.coalesce("root", "p").alias("root"))
    return roots


def follow(decisions: DataFrame) -> DataFrame:
    """old, new: merge decisions (one per old id) followed to their end; what runs into a loop names nobody.

    Pointers double every round, so a chain of n decisions takes log n rounds; what has not ended
    after as many rounds as its number has bits runs in a loop.
    """
    known = cut(decisions.filter("old IS NOT NULL AND new IS NOT NULL").select("old", "new").distinct())
    found, olds = known, known.select(F.col("old").alias("new"))
    for _ in range(known.count().bit_length() + 1):
        if not found.join(olds, "new", "left_semi").limit(1).count():
            break
        onward = found.select(F.col("old").alias("new"), F.col("new").alias("next"))
        found = cut(found.join(onward, "new", "left").select("old", F.coalesce("next", "new").alias("new")))
    return found.join(olds, "new", "left_anti").filter("old <> new").select("old", "new")
