"""Joins and merges of time spans (video_id, t_start, t_end), in seconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlaps(a: DataFrame, b: DataFrame, *, bucket_s: float | None = None, how: str = "inner") -> DataFrame:
    """Pairs of spans of one video that overlap (touching ends don't); all columns of a, and those of b with the prefix b_.

    With bucket_s the spans meet in buckets of time, so a long video costs what overlaps and not its square: a pair is
    kept in the first bucket that both reach.
    """
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    meet = (F.col("video_id") == F.col("b_video_id")) & (F.col("b_t_start") < F.col("t_end")) & (F.col("b_t_end") > F.col("t_start"))
    if bucket_s is None:
        return a.join(b, meet, how)
    if how != "inner":
        key = [F.col(c) for c in a.columns]
        inner = overlaps(a, b.toDF(*(c[2:] for c in b.columns)), bucket_s=bucket_s)
        alone = a.join(inner.select(*key).distinct(), [a[c].eqNullSafe(inner[c]) for c in a.columns], "left_anti")
        return inner.unionByName(alone, allowMissingColumns=True)

    def first(x: str) -> Column:
        return F.floor(F.col(x) / bucket_s)

    left = a.withColumn("_bucket", F.explode(F.sequence(first("t_start"), first("t_end"))))
    right = b.withColumn("_b_bucket", F.explode(F.sequence(first("b_t_start"), first("b_t_end"))))
    once = F.col("_bucket") == F.greatest(first("t_start"), first("b_t_start"))
    return left.join(right, meet & (F.col("_bucket") == F.col("_b_bucket")) & once).drop("_bucket", "_b_bucket")


#: Seconds of a bucket in which spans of one video meet.
BUCKET_S = 64.0


def containing(points: DataFrame, at: Column, spans: DataFrame, value: str, out: str, *, bucket_s: float = BUCKET_S) -> DataFrame:
    """points with `out`: the value of the first span by t_start with t_start <= at < t_end, else null.

    A span is in every bucket of time that it reaches and a point in one, so a long video is no product of both.
    """
    spans = spans.select(
        F.col("video_id").alias("_v"), F.col("t_start").alias("_a"), F.col("t_end").alias("_b"), F.col(value).alias("_value"), F.explode(F.sequence(F.floor(F.col("t_start") / bucket_s), F.floor(F.col("t_end") / bucket_s))).alias("_in")
    )
    placed = points.withColumn("_at", at).withColumn("_bucket", F.floor(F.col("_at") / bucket_s))
    met = placed.join(spans, (F.col("video_id") == F.col("_v")) & (F.col("_bucket") == F.col("_in")) & (F.col("_a") <= F.col("_at")) & (F.col("_at") < F.col("_b")), "left")
    return met.groupBy(*points.columns).agg(F.min(F.struct("_a", "_value"))["_value"].alias(out))


def merge_spans(spans: DataFrame, max_gap_s: float) -> DataFrame:
    """video_id, t_start, t_end, score, unit_ids of spans that touch, overlap or leave at most the gap.

    A span joins the run before it by the latest end so far, so spans within others do no harm. The best score stays;
    unit_ids are in the order of (t_start, unit_id).
    """
    order = Window.partitionBy("video_id").orderBy("t_start", "unit_id")
    reached = F.max("t_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.col("t_start") - reached <= max_gap_s, 0).otherwise(1)
    runs = spans.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = runs.groupBy("video_id", "_run").agg(
        F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("t_start", "unit_id"))).alias("_units")
    )
    return merged.select("video_id", "t_start", "t_end", "score", F.col("_units.unit_id").alias("unit_ids"))


def ranked_spans(spans: DataFrame) -> DataFrame:
    """Best score first; ties by video and start."""
    return spans.orderBy(F.desc("score"), "video_id", "t_start")
