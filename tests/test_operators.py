"""State transitions, grouping and evaluation: invariants on small tables."""

import itertools

import pytest
from pyspark.sql import functions as F
from quayside.operators import dedupe, evaluate, feed, grouping, ledger, publish
from quayside.sources.tables import gap_fill, official_posts, read_archive, split_quarantine

LISTING = "id string, is_locked boolean, source string"
SOURCE = "source_key string, event_ids array<string>, known_event_ids array<string>"
UPDATE = "source_key string, status string, row_ids array<string>, known_event_ids array<string>"


def published(spark, sources, updates, deleted=(), locked=()):
    rows = spark.createDataFrame([(i, i in locked, "instagram") for i in ("ig_a_p1", "ig_a_p2", "ig_b_p3")], LISTING)
    s, u = spark.createDataFrame(sources, SOURCE), spark.createDataFrame(updates, UPDATE)
    d = spark.createDataFrame([(x,) for x in deleted], "event_id string")
    out = publish.publish(rows, s, d, u)
    return {r.source_key: (sorted(r.event_ids), sorted(r.known_event_ids)) for r in out.collect()}, {r.id for r in publish.retired_listings(rows, s, out).collect()}


def test_an_error_never_shrinks_support(spark):
    got, gone = published(spark, [("k1", ["ig_a_p1"], ["ig_a_p1"])], [("k1", "error", [], ["ig_a_p2"])])
    assert got == {"k1": (["ig_a_p1", "ig_a_p2"], ["ig_a_p1", "ig_a_p2"])} and not gone


def test_a_row_stays_while_another_source_supports_it(spark):
    sources = [("k1", ["ig_a_p1"], ["ig_a_p1"]), ("k2", ["ig_a_p1"], ["ig_a_p1"])]
    assert published(spark, sources, [("k1", "complete", ["ig_a_p2"], [])])[1] == set()
    assert published(spark, sources[:1], [("k1", "complete", ["ig_a_p2"], [])])[1] == {"ig_a_p1"}


def test_locks_and_tombstones(spark):
    sources = [("k1", ["ig_a_p1"], ["ig_a_p1"])]
    assert published(spark, sources, [("k1", "complete", ["ig_a_p1"], [])], deleted=["ig_a_p1"])[0]["k1"][0] == []
    # a new id isn't taken up while the old one, no longer proposed, is locked
    got, gone = published(spark, sources, [("k1", "complete", ["ig_a_p2"], [])], locked=["ig_a_p1"])
    assert got["k1"][0] == [] and gone == set()


def test_publication_again_changes_nothing(spark):
    sources, updates = [("k1", ["ig_a_p1"], ["ig_a_p1"])], [("k1", "complete", ["ig_a_p1", "ig_a_p2"], ["ig_a_p2"])]
    first = published(spark, sources, updates)[0]["k1"]
    again = published(spark, [("k1", *first)], updates)[0]["k1"]
    assert first == again


def test_grouping_refuses_a_bridge_and_ignores_order(spark):
    rows = [("a", "2026-01-01 10:00:00"), ("b", "2026-01-01 10:00:00"), ("c", "2026-01-01 12:00:00"), ("d", "2026-01-01 10:00:00"), ("e", "2026-01-02 10:00:00")]
    matches = [("a", "b"), ("b", "c"), ("b", "d")]
    want = {"a": "a", "b": "a", "c": "c", "d": "a", "e": "e"}
    for order in list(itertools.permutations(rows))[::40]:
        df = spark.createDataFrame(order, "id string, s string").select("id", F.col("s").cast("timestamp_ntz").alias("starts_at"), F.lit(None).cast("timestamp_ntz").alias("ends_at"), F.lit(False).alias("all_day"))
        got = grouping.grouped(df.repartition(3), spark.createDataFrame(matches, "l_id string, r_id string"))
        assert {r.id: r.group_id for r in got.collect()} == want


def test_judged_pairs_stay_apart(spark):
    df = spark.createDataFrame([("a",), ("b",)], "id string").select("id", F.lit("2026-01-01 10:00:00").cast("timestamp_ntz").alias("starts_at"), F.lit(None).cast("timestamp_ntz").alias("ends_at"), F.lit(False).alias("all_day"))
    different = spark.createDataFrame([("a", "b")], "a string, b string")
    got = grouping.grouped(df, spark.createDataFrame([("a", "b")], "l_id string, r_id string"), different)
    assert {r.id: r.group_id for r in got.collect()} == {"a": "a", "b": "b"}


def test_merge_decisions_are_followed_and_loops_name_nobody(spark):
    got = dedupe.follow(spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "old string, new string"))
    assert sorted(map(tuple, got.collect())) == [("a", "c"), ("b", "c")]


def test_budget_is_spent_to_the_cent(spark):
    got = ledger.split_budget(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "name string, weight long"), 100)
    assert {r.name: r.share for r in got.collect()} == {"a": 34, "b": 33, "c": 33}


def test_streaks_skip_neutral_attempts(spark):
    rows = [("h", k, k, o) for k, o in enumerate(["failed", "neutral", "failed", "failed", "ok", "failed"])]
    got = ledger.failure_streaks(spark.createDataFrame(rows, "handle string, at long, id long, outcome string")).first()
    assert (got.longest, got.stops) == (3, True)


def test_auc_counts_ties_half(spark):
    got = evaluate.auc(spark.createDataFrame([(1, 5.0), (0, 5.0), (1, 2000.0), (0, 1.0)], "y int, x double"), "y", "x").first().auc
    assert got == pytest.approx((0.5 + 1 + 1 + 1) / 4)


def test_recall_without_reference_is_null(spark):
    a = spark.createDataFrame([("g", "1"), ("g", "2")], "g string, k string")
    b = spark.createDataFrame([("g", "2"), ("h", "3")], "g string, k string")
    assert {r.g: (r.matched, r.missing, r.extra, r.recall) for r in evaluate.recall_report(a, b, "g", "k").collect()} == {"g": (1, 1, 0, 0.5), "h": (0, 0, 1, None)}


def test_feed_parameters():
    q = feed.FeedQuery.from_params
    assert q({"cat": "social"}).category == "hangout" and q({"cat": "free_food"}).free_food and q({"cat": "nope", "when": "never"}) == feed.FeedQuery()


def test_archive_and_adapters(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"media_id": "1", "handle": "x", "posted_at": "2026-01-01T00:00:00Z"}')
    (tmp_path / "b.json").write_text('{"media_id": ')
    (tmp_path / "c.json").write_text('{"handle": "y"}')
    posts, bad = read_archive(spark, str(tmp_path))
    assert posts.count() == 1 and bad.count() == 2
    assert read_archive(spark, str(tmp_path), [])[0].count() == 0 and read_archive(spark, str(tmp_path), ["x"])[0].count() == 1
    rows = spark.createDataFrame([("1", "A", "2026-01-01T00:00:00Z", "https://x/1_n.jpg", "c"), ("2", None, "2026-01-01", None, "c")], "id string, ownerUsername string, timestamp string, displayUrl string, caption string")
    good, broken = split_quarantine(official_posts(rows))
    assert good.first().media_key == "1_n" and broken.first().errors == ["no owner", "bad timestamp", "no image"]
    mirror = spark.createDataFrame([("1", "mirror"), ("2", "mirror")], "k string, v string")
    assert sorted(map(tuple, gap_fill(mirror.filter("k = '1'").withColumn("v", F.lit("local")), mirror, "k").collect())) == [("1", "local"), ("2", "mirror")]


def test_stream_collects_each_post_once(spark, tmp_path):
    from quayside.streaming import collect

    source = tmp_path / "in"
    source.mkdir()

    def arrive(name, media, at):
        (source / f"{name}.json").write_text(f'{{"media_id": "{media}", "handle": "h", "posted_at": "{at}Z"}}')

    for n, (media, at) in enumerate([("1", "2026-01-01T00:00:00"), ("1", "2026-01-01T01:00:00"), ("2", "2026-01-01T02:00:00")]):
        arrive(n, media, at)
    schema = "media_id string, handle string, posted_at timestamp"
    posts, seen, store = collect.posts_stream(spark, str(source), schema), [], str(tmp_path / "store")
    for _ in range(2):
        collect.collect(posts, store, str(tmp_path / "ck"), lambda df, n: seen.append(df.count()))
    assert sum(seen) == 2
    # a known post returns after a year, and one comes that is older than all that was seen
    arrive("later", "1", "2027-06-01T00:00:00")
    arrive("older", "3", "2020-01-01T00:00:00")
    collect.collect(posts, store, str(tmp_path / "ck"), lambda df, n: seen.append(df.count()))
    assert sum(seen) == 3 and collect.progress(spark.read.parquet(store)).first().posts == 3


def test_long_chains_of_decisions(spark):
    chain = [(f"n{k}", f"n{k + 1}") for k in range(70)]
    got = dedupe.follow(spark.createDataFrame(chain, "old string, new string")).collect()
    assert len(got) == 70 and {r.new for r in got} == {"n70"}


def test_shingle_pairs_with_frequent_shingles(spark):
    """However few texts a shingle may be in to be counted pair by pair, the pairs are the same."""
    import random

    r = random.Random(4)
    words = [f"w{k}" for k in range(40)]
    usual = " ".join(words)
    texts = [(k, " ".join([usual if k % 3 else "", *r.choices(words, k=r.randint(0, 60))])) for k in range(40)]
    classes = dedupe.cut(dedupe.shingle_classes(spark.createDataFrame(texts, "id int, text string"), "id", "text"))
    shingles = {c: set(s) for c, s in classes.select("class", "shingles").collect()}
    want = {(a, b, n) for a in shingles for b in shingles if a < b and (n := len(shingles[a] & shingles[b])) >= 20}
    for often in (1, 5, 1000):
        assert {tuple(p) for p in dedupe.shingle_pairs(classes, "id", often=often).collect()} == want


def test_review_pairs_shuffle_listings_not_pairs(spark):
    """A day on which all listings pair with all others: plain pairs, and no exchange or sort above the join that makes them."""
    rows = spark.range(60).select(
        F.concat(F.lit("e"), "id").alias("id"), F.lit("student_event").alias("content_kind"), F.lit("2026-10-05").cast("date").alias("day"),
        F.when(F.col("id") % 3 == 0, "Chess Open Night").when(F.col("id") % 3 == 1, "open night of chess and go").otherwise("Go").alias("title"),
        F.lit("2026-10-05 19:00:00").cast("timestamp_ntz").alias("starts_at"), F.lit(None).cast("timestamp_ntz").alias("ends_at"),
    )
    found = dedupe.review_pairs(rows)
    got = {(r.l_id, r.r_id, r.common) for r in found.select("l_id", "r_id", "common").collect()}
    alike = [k for k in range(60) if k % 3 < 2]
    want = {(*sorted((f"e{a}", f"e{b}")), 4 if a % 3 == b % 3 == 1 else 3) for a in alike for b in alike if a < b}
    assert got == want and found.count() == len(want)
    plan = found.select("l_id", "r_id", "common")._jdf.queryExecution().sparkPlan().toString()
    above = plan.split("Join", 1)[0]
    assert "Aggregate" not in above and plan.count("Join") == 2  # the pairs are neither made distinct nor joined with the listings again
