"""Reports that compare decisions with references."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import cut


def recall_report(reference: DataFrame, candidate: DataFrame, group: str, key: str) -> DataFrame:
    """matched, missing and extra per group, and the recall, null where there is no reference."""
    r, c = reference.select(group, key).distinct().withColumn("in_r", F.lit(1)), candidate.select(group, key).distinct().withColumn("in_c", F.lit(1))
    both = r.join(c, [group, key], "full")
    has = lambda x: F.col(x).isNotNull()
    counts = both.groupBy(group).agg(
        F.count_if(has("in_r") & has("in_c")).alias("matched"), F.count_if(has("in_r") & ~has("in_c")).alias("missing"), F.count_if(~has("in_r") & has("in_c")).alias("extra")
    )
    return counts.withColumn("recall", F.try_divide(F.col("matched"), F.col("matched") + F.col("missing")))


def agreement(rows: DataFrame, truth: str, verdict: str, verdicts: list[str]) -> DataFrame:
    """truth by verdict, counts as columns."""
    return rows.groupBy(truth).agg(*(F.count_if(F.col(verdict) == v).alias(v) for v in verdicts))


def auc(rows: DataFrame, label: str, score: str) -> DataFrame:
    """Chance that a positive scores above a negative, ties half: by counts per distinct score, so that no row is paired.

    Distinct scores are dealt into ranges; what lies below a range comes from totals, one row a range.
    """
    per = rows.groupBy(score).agg(F.sum(label).cast("double").alias("p"), F.sum(1 - F.col(label)).cast("double").alias("n"))
    ranged = cut(per.repartitionByRange(score).withColumn("part", F.spark_partition_id()))
    totals = ranged.groupBy("part").agg(F.sum("n").alias("bn"))
    before = totals.withColumn("below", F.coalesce(F.sum("bn").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("part", "below")  # one row per range
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    placed = ranged.withColumn("inside", inside).join(before, "part")
    return placed.agg(F.try_divide(F.sum(F.col("p") * (F.col("below") + F.col("inside") + F.col("n") / 2)), F.sum("p") * F.sum("n")).alias("auc"))


def round_robin(rows: DataFrame, group: str, key: str, each: int) -> DataFrame:
    """The first rows of every group in turn."""
    n = F.row_number().over(Window.partitionBy(group).orderBy(key))
    return rows.withColumn("turn", n).filter(F.col("turn") <= each)


def usage_share(rows: DataFrame, size: str, limit: int, alarm: float = 0.8) -> DataFrame:
    """used, files, share of the limit, alarm."""
    total = rows.agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("used"), F.count("*").alias("files"))
    return total.withColumn("share", F.col("used") / F.lit(float(limit))).withColumn("alarm", F.col("share") >= alarm)
