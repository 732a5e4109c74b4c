"""Time lines made from tables of conversations and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.text import split_words
from tidemark.operators.segment import fixed_spans
from tidemark.settings import Clips

#: Seconds that a word and a change of turn take.
WORD_S, TURN_S = 0.5, 1.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(conversations: DataFrame) -> DataFrame:
    """video_id, turn, word_no, t_start, t_end, text: every word of a conversation, one after the other."""
    split = conversations.select(F.col("conv_id").cast("string").alias("video_id"), "turn", split_words(F.coalesce("text", F.lit(""))).alias("w"))
    before = Window.partitionBy("video_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = split.withColumn("before", F.coalesce(F.sum(F.size("w")).over(before), F.lit(0)))
    each = placed.select("video_id", "turn", "before", F.posexplode("w").alias("pos", "text")).withColumn("word_no", (F.col("before") + F.col("pos")).cast("long"))
    start = F.col("word_no") * WORD_S + F.col("turn") * TURN_S
    return each.select("video_id", "turn", "word_no", start.alias("t_start"), (start + WORD_S).alias("t_end"), "text")


def turns(all_words: DataFrame) -> DataFrame:
    """One sentence for each turn: id, video_id, turn, t_start, t_end, text."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("word_no", "text"))), lambda x: x["text"]), " ")
    rows = all_words.groupBy("video_id", "turn").agg(F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), text.alias("text"))
    return rows.select(F.col("turn").alias("id"), "video_id", "turn", "t_start", "t_end", "text")


def videos(all_turns: DataFrame) -> DataFrame:
    """video_id, duration_s, chapters: one chapter for each turn."""
    chapters = F.array_sort(F.collect_list(F.struct(F.col("t_start").alias("start_time"), F.col("t_end").alias("end_time"))))
    return all_turns.groupBy("video_id").agg(F.max("t_end").alias("duration_s"), chapters.alias("chapters"))


def clips(all_videos: DataFrame, settings: Clips) -> DataFrame:
    """unit_id, video_id, unit_no, t_start, t_end of fixed windows; unit_id joins the video's number and the window's.

    A video has room for a million windows there; those beyond have negative ids, of which none can be another's.
    """
    spans = fixed_spans(F.col("duration_s"), settings.target_s, settings.target_s * settings.stride_ratio, settings.min_s)
    rows = all_videos.select("video_id", F.posexplode(spans).alias("unit_no", "s"))
    video, no = F.col("video_id").cast("long"), F.col("unit_no").cast("long")
    unit_id = F.when(no < 1_000_000, video * 1_000_000 + no).otherwise(-(video * (1 << 31) + no))
    return rows.select(unit_id.alias("unit_id"), "video_id", F.col("unit_no").cast("long").alias("unit_no"), "s.t_start", "s.t_end")


def event_seconds(events: DataFrame) -> DataFrame:
    """video_id (the user), event_id, t in whole seconds since 2024, value."""
    t = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000) - F.lit(1_704_067_200)
    return events.select(F.col("user_id").cast("string").alias("video_id"), "event_id", t.cast("double").alias("t"), "value", "event_type")


def event_spans(seconds: DataFrame, length_s: float) -> DataFrame:
    return seconds.select("video_id", F.col("t").alias("t_start"), (F.col("t") + length_s).alias("t_end"), F.col("value").alias("score"), F.col("event_id").alias("unit_id"))


def event_shots(seconds: DataFrame) -> DataFrame:
    """From each event of a user to the next that is later."""
    own = seconds.select("video_id", "t").distinct()
    return own.select("video_id", F.col("t").alias("t_start"), F.lead("t").over(Window.partitionBy("video_id").orderBy("t")).alias("t_end")).where("t_end IS NOT NULL")
