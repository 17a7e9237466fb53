"""What a republication leaves out: repeats that a reconciliation merged before, and posts that a corrected repost replaces.

A source whose decision has not changed proposes again the rows that were merged away.  Such a row
is withheld while it still matches the listing it was merged into, directly or through another
withheld row.  So groups grow from the live listings over the matches among their pending rows: a
fixpoint whose rounds join only what the last round added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from ..sources.tables import cut
from . import grouping, pairs
from .dedupe import follow

_POST_LISTING = r"^ig_.+_p([0-9]+)(-[0-9A-Za-z]+)*$"


def own_listing(listing: Column, source_key: Column) -> Column:
    """Whether a listing is that of the post itself: its single event, or one of its sessions."""
    return F.coalesce(F.nullif(F.regexp_extract(listing, _POST_LISTING, 1), F.lit("")) == F.substring_index(source_key, ":", -1), F.lit(False))


def pending_rows(proposed: DataFrame, registry: DataFrame, live: DataFrame) -> DataFrame:
    """canonical, id, place of rows that may have been merged into a live listing.

    proposed: source_key, position (of the source in this run), row_no, id, assessment; registry:
    source_key, assessment, event_ids, known_event_ids; live: id, is_locked.  Only sources whose
    assessment is the stored one count.  A single row is pending on the one other listing that its
    source supports.  Of several rows, those known but not supported any more are pending on each
    foreign listing of the source that is locked or has another supporter; a source has few of
    either.  place orders the listings as a run comes upon them.
    """
    stored = registry.select("source_key", F.col("assessment").alias("stored"), F.coalesce("event_ids", F.array()).alias("supported"), F.coalesce("known_event_ids", F.array()).alias("known"))
    counted = proposed.groupBy("source_key").agg(F.count("*").alias("rows"))
    same = proposed.join(stored, "source_key").filter(F.col("assessment").eqNullSafe(F.col("stored"))).join(counted, "source_key")
    same = same.filter(F.array_contains("known", F.col("id")))
    single = same.filter((F.col("rows") == 1) & (F.size("supported") == 1) & (F.col("supported")[0] != F.col("id")))
    single = single.select(F.col("supported")[0].alias("canonical"), "id", F.struct("position", "source_key", "row_no", F.lit(0).alias("n")).alias("place"))
    supporters = registry.select("source_key", F.explode(F.array_distinct("event_ids")).alias("canonical")).groupBy("canonical").agg(F.count("*").alias("supporters"))
    several = same.filter((F.col("rows") > 1) & ~F.array_contains("supported", F.col("id")))
    listed = several.select("source_key", "position", "row_no", "id", "supported", F.posexplode(F.array_union("supported", "known")).alias("n", "canonical"))
    foreign = listed.filter(~own_listing(F.col("canonical"), F.col("source_key"))).join(live.select(F.col("id").alias("canonical"), "is_locked"), "canonical").join(supporters, "canonical", "left")
    others = F.coalesce("supporters", F.lit(0)) - F.array_contains("supported", F.col("canonical")).cast("int")
    several = foreign.filter(F.coalesce("is_locked", F.lit(False)) | (others > 0)).select("canonical", "id", F.struct("position", "source_key", "row_no", "n").alias("place"))
    found = single.join(live.select(F.col("id").alias("canonical")), "canonical", "left_semi").unionByName(several)
    return found.groupBy("canonical", "id").agg(F.min("place").alias("place"))


def _both_ways(matches: DataFrame) -> DataFrame:
    ways = matches.select("l_id", "r_id").filter("l_id <> r_id")
    return ways.select(F.col("l_id").alias("id"), F.col("r_id").alias("member")).unionByName(ways.select(F.col("r_id").alias("id"), F.col("l_id").alias("member"))).distinct()


def grown_groups(pending: DataFrame, matches: DataFrame, traits: DataFrame, decided: DataFrame) -> DataFrame:
    """canonical, id of the rows that join each listing's group, every group for itself.

    matches (l_id, r_id); traits: id, incomplete, detailed (others have neither); decided: id, kept, a
    merge that a person decided.  In a round a row joins if it matches a member, unless that would
    bring an incomplete session together with detailed rows that don't match one another; a decided
    row joins with what it is kept in.  Counts per row and group say so, and a round joins only the
    matches of what the last one added: chains take as many rounds as they are long, loops none more.
    """
    inside = pending.select("canonical", "id").distinct()
    everyone = inside.unionByName(inside.select("canonical", F.col("canonical").alias("id")).distinct()).distinct()
    of = everyone.join(traits.select("id", "incomplete", "detailed"), "id", "left").select("canonical", "id", F.coalesce("incomplete", F.lit(False)).alias("incomplete"), F.coalesce("detailed", F.lit(False)).alias("detailed"))
    of = cut(of)
    seen_from = inside.join(_both_ways(matches), "id").join(everyone.withColumnRenamed("id", "member"), ["canonical", "member"])
    links = cut(seen_from.select("canonical", "id", "member"))
    kept = inside.join(decided.select("id", F.col("kept").alias("member")), "id").join(everyone.withColumnRenamed("id", "member"), ["canonical", "member"]).select("canonical", "id", "member")
    kept = cut(kept)
    heads = of.filter("id = canonical")
    delta = heads
    waiting = of.filter("id <> canonical").withColumns({"matched": F.lit(False), "told": F.lit(False), "met": F.lit(0).cast("long")})
    stats = heads.groupBy("canonical").agg(F.sum(F.col("detailed").cast("long")).alias("many"), F.bool_or("incomplete").alias("vague"), F.lit(0).cast("long").alias("agreed"))
    joined: list[DataFrame] = []
    while True:
        new = delta.select("canonical", F.col("id").alias("member"), F.col("detailed").alias("of_detailed"))
        touched = links.join(new, ["canonical", "member"]).groupBy("canonical", "id").agg(F.lit(True).alias("hit"), F.sum(F.col("of_detailed").cast("long")).alias("more"))
        named = kept.join(new, ["canonical", "member"]).select("canonical", "id", F.lit(True).alias("said")).distinct()
        on = ["canonical", "id"]
        waiting = waiting.join(touched, on, "left").join(named, on, "left").select(
            *on, "incomplete", "detailed", (F.col("matched") | F.coalesce("hit", F.lit(False))).alias("matched"), (F.col("told") | F.coalesce("said", F.lit(False))).alias("told"), (F.col("met") + F.coalesce("more", F.lit(0))).alias("met")
        )
        at_odds = (F.col("agreed") < F.expr("many * (many - 1) DIV 2")) | (F.col("detailed") & (F.col("met") < F.col("many")))
        judged = cut(waiting.join(stats, "canonical").withColumn("joins", F.col("told") | (F.col("matched") & ~((F.col("vague") | F.col("incomplete")) & at_odds))))
        delta = judged.filter("joins").select("canonical", "id", "incomplete", "detailed", "met")
        if not delta.limit(1).count():
            break
        joined.append(delta.select("canonical", "id"))
        waiting = judged.filter("NOT joins").select(*on, "incomplete", "detailed", "matched", "told", "met")
        precise = delta.filter("detailed").select("canonical", "id")
        among = links.join(precise, on, "left_semi").join(precise.withColumnRenamed("id", "member"), ["canonical", "member"], "left_semi").groupBy("canonical").agg((F.count("*") / 2).cast("long").alias("inner"))
        added = delta.groupBy("canonical").agg(F.sum(F.col("detailed").cast("long")).alias("d"), F.bool_or("incomplete").alias("v"), F.sum(F.when(F.col("detailed"), F.col("met")).otherwise(0)).alias("a"))
        stats = cut(
            stats.join(added, "canonical", "left").join(among, "canonical", "left").select(
                "canonical", (F.col("many") + F.coalesce("d", F.lit(0))).alias("many"), (F.col("vague") | F.coalesce("v", F.lit(False))).alias("vague"), (F.col("agreed") + F.coalesce("a", F.lit(0)) + F.coalesce("inner", F.lit(0))).alias("agreed")
            )
        )
    out = inside.limit(0)
    for part in joined:
        out = out.unionByName(part)
    return out


def withheld_rows(pending: DataFrame, matches: DataFrame, traits: DataFrame, decided: DataFrame) -> DataFrame:
    """canonical, id: every row at most once, at the first of its listings (by place) whose group takes it.

    Groups grow side by side.  A group is settled if it holds no row that is pending at an earlier,
    unsettled listing too; then its rows are taken from all others, and those grow anew.  The first
    unsettled listing always settles.
    """
    left = cut(pending.select("canonical", "id", "place"))
    out = None
    while left.limit(1).count():
        first = left.groupBy("canonical").agg(F.min("place").alias("turn"))
        turns = cut(left.join(first, "canonical").select("canonical", "id", "turn"))
        groups = cut(grown_groups(left, matches, traits, decided))
        claimed = groups.join(first, "canonical")
        # where a row of a group waits at an earlier listing as well, the group isn't settled
        rivals = turns.groupBy("id").agg(F.min("turn").alias("earliest"))
        open_ones = claimed.join(rivals, "id").filter("earliest < turn").select("canonical").distinct()
        settled = cut(first.select("canonical").join(open_ones, "canonical", "left_anti"))
        taken = cut(groups.join(settled, "canonical", "left_semi"))
        out = taken if out is None else out.unionByName(taken)
        left = cut(left.join(settled, "canonical", "left_anti").join(taken.select("id"), "id", "left_anti"))
    return out if out is not None else pending.select("canonical", "id").limit(0)


# --- corrected reposts -------------------------------------------------------------------------


def described_by(listing: dict[str, Column], source: dict[str, Column], names_venue: Column) -> dict[str, Column]:
    """A listing's columns with link, caption and picture of another post, and its venue where it names one."""
    return {**listing, **{c: source[c] for c in ("source_url", "description", "image_url")}, "location": F.when(names_venue, source["location"]).otherwise(listing["location"])}


def preferred_reposts(winners: DataFrame, known: DataFrame, matches: DataFrame, decided: DataFrame, different: DataFrame | None = None) -> DataFrame:
    """winner, source: the newest repost that corrects a listing.

    winners: id of listings; known: facts of winners and of all rows that may repeat them; matches
    (l_id, r_id) of them; decided: id, kept; different: pairs judged different.  A repost is of the same
    account, by a later post, of the same start and shape; it says no less: a caption, and every detail
    and venue that the listing has.  Locked listings, those of no post, and those of which a person
    decided anything stay as they are.  Reposts that don't all match each other correct nothing.
    """
    posted = F.coalesce(urls.permalink_media_id(F.col("source_url")), F.lit(0).cast("decimal(20,0)"))
    has = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) != ""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    names = ~F.col("f_venue_only") & (F.size("f_place") > 0)
    facts = known.select(
        "id", posted.alias("posted"), F.col("f_account").alias("account"), "starts_at", F.col("f_date_only").alias("only"), yes("all_day").alias("all_day"), F.col("f_is_session").alias("session"),
        ((F.col("source") == "instagram") & F.col("id").startswith("ig_")).alias("imported"), yes("is_locked").alias("locked"), names.alias("names"), (F.trim(F.coalesce("description", F.lit(""))) != "").alias("says"),
        *((has(c) if c != "has_free_food" else yes(c)).alias(f"has_{c}") for c in ("ends_at", "image_url", "rsvp_url", "has_free_food")),
    )
    touched = decided.select("id").unionByName(decided.select(F.col("kept").alias("id"))).distinct()
    side = lambda p, df: df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns))
    old = side("o", facts.join(winners.select("id").distinct(), "id", "left_semi").join(touched, "id", "left_anti").filter("imported AND NOT locked AND posted > 0"))
    new = side("n", facts.join(decided.select("id"), "id", "left_anti").filter("imported AND says"))
    near = _both_ways(matches).select(F.col("id").alias("o_id"), F.col("member").alias("n_id"))
    if different is not None:
        near = near.join(_both_ways(different.select(F.col("a").alias("l_id"), F.col("b").alias("r_id"))).select(F.col("id").alias("o_id"), F.col("member").alias("n_id")), ["o_id", "n_id"], "left_anti")
    met = near.join(old, "o_id").join(new, "n_id")
    same = F.lit(True)
    for c in ("starts_at", "only", "all_day", "session"):
        same = same & F.col(f"o_{c}").eqNullSafe(F.col(f"n_{c}"))
    no_less = ~(F.col("o_names") & ~F.col("n_names"))
    for c in ("has_ends_at", "has_image_url", "has_rsvp_url", "has_has_free_food"):
        no_less = no_less & ~(F.col(f"o_{c}") & ~F.col(f"n_{c}"))
    good = cut(met.filter((F.col("n_posted") > F.col("o_posted")) & (F.col("o_account") != "") & (F.col("o_account") == F.col("n_account")) & same & no_less).select("o_id", "n_id", "n_posted"))
    # of n reposts all n (n - 1) / 2 pairs have to match
    peers = good.select("o_id", F.col("n_id").alias("member"))
    agreeing = good.select("o_id", F.col("n_id").alias("id")).join(_both_ways(matches), "id").join(peers, ["o_id", "member"]).groupBy("o_id").agg(F.count("*").alias("agreeing"))
    best = good.groupBy("o_id").agg(F.count("*").alias("n"), F.max(F.struct("n_posted", "n_id")).alias("best")).join(agreeing, "o_id", "left")
    return best.filter(F.coalesce("agreeing", F.lit(0)) == F.col("n") * (F.col("n") - 1)).select(F.col("o_id").alias("winner"), F.col("best.n_id").alias("source"))


# --- a whole run -------------------------------------------------------------------------------

#: What a merge or an adopted post may change in a row.
DETAILS = ("has_free_food", "ends_at", "rsvp_url", "image_url", "location", "source_url", "description")


def withhold(proposed: DataFrame, registry: DataFrame, live: DataFrame, forced: DataFrame | None = None, different: DataFrame | None = None) -> DataFrame:
    """The rows that a run publishes, with `published_from`: the id under which a row was proposed.

    proposed and live are listings (with source_url and image_url), proposed also with source_key,
    position, row_no and assessment; registry as in `pending_rows`, with `deleted` (the post is gone).
    forced (old, new): merges by hand; different (a, b): pairs judged different.  Withheld rows go; a
    listing that its source proposes again takes the details of those withheld for it; one whose post
    is gone and that isn't locked is published under its id from the newest of them; and a row takes
    link, caption, picture and venue of a corrected repost.  Hosts aren't published.  Where a
    proposed row has the id of a live listing, it is read as proposed.  No rows: no rows.
    """
    spark = proposed.sparkSession
    decided = follow(forced).select(F.col("old").alias("id"), F.col("new").alias("kept")) if forced is not None else spark.createDataFrame([], "id string, kept string")
    extra = ("source_key", "position", "row_no", "assessment")
    listed = [c for c in proposed.columns if c not in extra]
    both = proposed.select(listed).unionByName(live.join(proposed.select("id"), "id", "left_anti").select(listed))
    known = cut(pairs.facts(both))
    matched = pairs.same_event(pairs.matchable_pairs(known)).filter("verdict")
    edges = cut(matched.select("l_id", "r_id"))
    pending = cut(pending_rows(proposed, registry, live))
    # a row that could tell of several events is pending only where a person put it
    ambiguous = grouping.conflicting_summaries(known, matched).withColumn("unclear", F.lit(True))
    pending = pending.join(ambiguous, "id", "left").join(decided, "id", "left").filter(F.col("unclear").isNull() | F.col("kept").eqNullSafe(F.col("canonical"))).select("canonical", "id", "place")
    traits = known.select("id", F.col("f_incomplete").alias("incomplete"), (F.col("f_slot") & (F.size("f_place") > 0)).alias("detailed"))
    held = cut(withheld_rows(pending, edges, traits, decided))
    adopted = cut(_adopted(held, known, registry, live, different))
    stay = proposed.join(held.select("id").distinct(), "id", "left_anti").withColumn("published_from", F.col("id"))
    source = known.select("id", *(F.col(c).alias(f"s_{c}") for c in DETAILS), (~F.col("f_venue_only") & (F.size("f_place") > 0)).alias("names"))
    moved = proposed.drop(*(c for c in listed if c != "id")).join(adopted, F.col("id") == F.col("source")).drop("source").withColumnRenamed("id", "published_from")
    moved = moved.join(live.select(listed).withColumnRenamed("id", "canonical"), "canonical").join(source.withColumnRenamed("id", "published_from"), "published_from")
    named = described_by({c: F.col(c) for c in DETAILS}, {c: F.col(f"s_{c}") for c in DETAILS}, F.col("names"))
    moved = moved.withColumns(named).withColumnRenamed("canonical", "id").select(stay.columns)
    rows = cut(stay.unionByName(moved))
    rows = _with_details(rows, held, known, registry, live)
    unlocked = rows.join(live.filter("is_locked").select("id"), "id", "left_anti").select("id")
    newer = preferred_reposts(unlocked, known, edges, decided, different).select(F.col("winner").alias("id"), F.col("source").alias("newer"))
    better = rows.join(newer, "id", "left").join(source.withColumnRenamed("id", "newer"), "newer", "left")
    corrected = described_by({c: F.col(c) for c in DETAILS}, {c: F.col(f"s_{c}") for c in DETAILS}, F.coalesce("names", F.lit(False)))
    changed = {c: F.when(F.col("newer").isNotNull(), corrected[c]).otherwise(F.col(c)) for c in ("source_url", "description", "image_url", "location")}
    return better.withColumns(changed).select(rows.columns)


def _adopted(held: DataFrame, known: DataFrame, registry: DataFrame, live: DataFrame, different: DataFrame | None) -> DataFrame:
    """canonical, source: listings whose post is gone, and the newest row withheld for them that isn't judged different."""
    gone = registry.filter("deleted").select(F.substring_index("source_key", ":", -1).alias("media")).distinct()
    posts = pairs.facts(live.filter("NOT coalesce(is_locked, false)").join(held.select(F.col("canonical").alias("id")).distinct(), "id", "left_semi"))
    orphaned = posts.select(F.col("id").alias("canonical"), F.explode("f_media").alias("media")).join(gone, "media", "left_semi").select("canonical").distinct()
    offers = held.join(orphaned, "canonical", "left_semi")
    if different is not None:
        offers = offers.join(_both_ways(different.select(F.col("a").alias("l_id"), F.col("b").alias("r_id"))).withColumnRenamed("member", "canonical"), ["canonical", "id"], "left_anti")
    newest = offers.join(known.select("id", "f_newest"), "id").groupBy("canonical").agg(F.max(F.struct("f_newest", "id")).alias("best"))
    return newest.select("canonical", F.col("best.id").alias("source"))


def _with_details(rows: DataFrame, held: DataFrame, known: DataFrame, registry: DataFrame, live: DataFrame) -> DataFrame:
    """Rows with what the rows withheld for them add; a venue they name as before stays where nothing better is said."""
    repeats = held.join(rows.select(F.col("id").alias("canonical")).distinct(), "canonical", "left_semi")
    changed = rows.select([c for c in known.columns if c in rows.columns])
    heads = pairs.facts(changed.join(repeats.select(F.col("canonical").alias("id")).distinct(), "id", "left_semi")).withColumns({"group_id": F.col("id"), "rank": F.lit(1)})
    tail = known.join(repeats.withColumnRenamed("canonical", "group_id"), "id").withColumn("rank", F.lit(2))
    merged = grouping.merged_details(heads.unionByName(tail.select(heads.columns)))
    merged = merged.select(F.col("group_id").alias("id"), *(F.col(c).alias(f"m_{c}") for c in ("has_free_food", "ends_at", "rsvp_url", "image_url", "location")))
    before = live.select("id", F.col("location").alias("was"))
    spelled = repeats.join(known.select("id", F.col("location").alias("was")), "id").select(F.col("canonical").alias("id"), "was").distinct().join(before, ["id", "was"], "left_semi").filter("was <> ''")
    same = registry.select("source_key", F.col("assessment").alias("stored"))
    out = rows.join(merged, "id", "left").join(spelled, "id", "left").join(same, "source_key", "left")
    has = F.col("m_has_free_food").isNotNull()
    picked = {c: F.when(has, F.col(f"m_{c}")).otherwise(F.col(c)) for c in ("has_free_food", "ends_at", "rsvp_url", "image_url", "location")}
    keeps = has & (F.coalesce(picked["location"], F.lit("")) == "") & F.col("was").isNotNull() & F.col("assessment").eqNullSafe(F.col("stored"))
    picked["location"] = F.when(keeps, F.col("was")).otherwise(picked["location"])
    return cut(out.withColumns(picked).select(rows.columns))
