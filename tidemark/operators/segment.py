"""Cutting time lines into units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.fold import bound, group_starts, groups, sorted_items
from tidemark.functions.text import word_count
from tidemark.operators.intervals import containing
from tidemark.settings import Clips, Scenes, Settings

SILENT = "silent"


def fixed_spans(duration: Column, target_s: float, stride_s: float, min_s: float) -> Column:
    """Array of (t_start, t_end): windows of target_s every stride_s, a rest shorter than min_s joined to the last.

    The number of windows has a closed form, so nothing is iterated: see last_window.
    """
    if stride_s <= 0:
        raise ValueError("the stride must be positive")

    def window(i: Column) -> Column:
        start = i * stride_s
        end = F.least(start + target_s, duration)
        return F.struct(start.cast("double").alias("t_start"), F.when(duration - end < min_s, duration).otherwise(end).cast("double").alias("t_end"))

    whole = F.array(F.struct(F.lit(0.0).alias("t_start"), duration.cast("double").alias("t_end")))
    none = F.slice(whole, 1, 0)
    many = F.transform(F.sequence(F.lit(0).cast("long"), last_window(duration, target_s, stride_s, min_s)), window)
    return F.when(F.coalesce(duration, F.lit(0.0)) <= 0, none).when(duration <= target_s, whole).otherwise(many)


def last_window(duration: Column, target_s: float, stride_s: float, min_s: float) -> Column:
    """Index of the first window that reaches the end, or leaves less than min_s after it."""
    if min_s > 0:
        reaches = F.floor((duration - min_s - target_s) / stride_s) + 1
    else:
        reaches = F.ceil((duration - target_s) / stride_s)
    return F.least(F.greatest(reaches, F.lit(0)), F.ceil(duration / stride_s) - 1).cast("long")


def split_long(span: Column, max_s: float) -> Column:
    """Array: the span, or equal pieces of at most max_s; the last ends where the span does."""
    length = span["t_end"] - span["t_start"]
    n = F.greatest(F.ceil(length / max_s), F.lit(1))

    def piece(i: Column) -> Column:
        step = length / n
        start = F.when(i == 0, span["t_start"]).otherwise(span["t_start"] + i * step)
        return F.struct(start.alias("t_start"), F.when(i == n - 1, span["t_end"]).otherwise(span["t_start"] + (i + 1) * step).alias("t_end"))

    return F.transform(F.sequence(F.lit(0).cast("long"), n - 1), piece)


def absorb_tail(spans: Column, min_s: float) -> Column:
    """The spans, the last joined to the one before if it is shorter than min_s."""

    def joined(own: Column) -> Column:
        n = F.size(own)
        last, before = F.get(own, n - 1), F.get(own, n - 2)
        short = (n >= 2) & (last["t_end"] - last["t_start"] < min_s)
        both = F.struct(before["t_start"].alias("t_start"), last["t_end"].alias("t_end"))
        return F.when(short, F.concat(F.slice(own, 1, F.greatest(n - 2, F.lit(0))), F.array(both))).otherwise(own)

    return bound(spans, joined)


def accumulated(items: Column, least_s: float, rest_end: Column, max_s: float, min_s: float, keep_rest: Column | None = None) -> Column:
    """Spans from runs of items that last least_s; what is left over ends at rest_end. Long ones are split, a short tail joined."""

    def span(run: Column) -> Column:
        start, end = F.get(run, F.lit(0))["t_start"], F.element_at(run, -1)["t_end"]
        return F.struct(start.alias("t_start"), F.when(end - start >= least_s, end).otherwise(rest_end).alias("t_end"), (end - start >= least_s).alias("full"))

    def cut(own: Column) -> Column:
        runs = groups(own, group_starts(own, ["t_start"], lambda first, item, n: item["t_end"] - first["t_start"] >= least_s, after=True))
        spans = F.filter(F.transform(runs, span), lambda s: s["full"] | (F.lit(True) if keep_rest is None else keep_rest > s["t_start"]))
        return F.flatten(F.transform(spans, lambda s: split_long(s, max_s)))

    return absorb_tail(bound(items, cut), min_s)


def shot_spans(shots: Column, duration: Column, target_s: float, max_s: float, min_s: float) -> Column:
    """Spans cut at shots (a sorted array); without shots, fixed windows."""
    cut = accumulated(shots, target_s, duration, max_s, min_s, keep_rest=duration)
    return F.when(F.coalesce(F.size(shots), F.lit(0)) <= 0, fixed_spans(duration, target_s, target_s, min_s)).otherwise(cut)


def chapter_spans(chapters: Column, duration: Column, scenes: Scenes) -> Column:
    """Scenes from chapters (start_time, end_time): short ones are merged forward, long ones split."""
    filled = F.transform(chapters, lambda c: F.struct(F.coalesce(c["start_time"], F.lit(0.0)).alias("t_start"), F.coalesce(c["end_time"], duration).alias("t_end")))
    kept = F.transform(F.filter(filled, lambda c: c["t_end"] > c["t_start"]), lambda c: F.struct(c["t_start"].alias("t_start"), F.least(c["t_end"], duration).alias("t_end")))

    def merged(own: Column) -> Column:
        rest = F.element_at(F.when(F.size(own) > 0, own), -1)["t_end"]
        return F.when(F.size(own) > 0, accumulated(own, scenes.min_s, rest, scenes.max_s, scenes.min_s)).otherwise(F.slice(own, 1, 0))

    return bound(kept, merged)


def close_shots(boundaries: Column, duration: Column) -> Column:
    """Shots that begin at 0 and end at the duration: boundaries clamped, empty ones dropped; one shot if none is left."""
    clamped = F.transform(
        boundaries, lambda s: F.struct(F.least(F.greatest(s["t_start"], F.lit(0.0)), duration).alias("t_start"), F.least(F.greatest(s["t_end"], F.lit(0.0)), duration).alias("t_end"))
    )
    whole = F.array(F.struct(F.lit(0.0).alias("t_start"), duration.alias("t_end")))

    def closed(kept: Column) -> Column:
        n = F.size(kept)
        return F.when(
            n > 0,
            F.transform(kept, lambda s, i: F.struct(F.when(i == 0, 0.0).otherwise(s["t_start"]).alias("t_start"), F.when(i == n - 1, duration).otherwise(s["t_end"]).alias("t_end"))),
        ).otherwise(whole)

    spans = bound(F.filter(clamped, lambda s: s["t_end"] > s["t_start"]), closed)
    return F.when(F.coalesce(duration, F.lit(0.0)) <= 0, F.slice(whole, 1, 0)).otherwise(F.coalesce(spans, whole))


def speech_density(videos: DataFrame, sentences: DataFrame) -> DataFrame:
    """videos with `density`, the words spoken a second; 0 without duration or speech."""
    spoken = sentences.groupBy("video_id").agg(F.sum(word_count(F.col("text"))).alias("_words"))
    density = F.when(F.col("duration_s") > 0, F.coalesce("_words", F.lit(0)) / F.col("duration_s")).otherwise(0.0)
    return videos.join(spoken, "video_id", "left").withColumn("density", F.coalesce(density, F.lit(0.0))).drop("_words")


def clip_spans(shots: Column, duration: Column, density: Column, clips: Clips, silent_below: float) -> Column:
    """Clips of one video: along its shots if it is silent, else fixed windows."""
    spoken = fixed_spans(duration, clips.target_s, clips.target_s * clips.stride_ratio, clips.min_s)
    return F.when(density < silent_below, shot_spans(shots, duration, clips.target_s, clips.max_s, clips.min_s)).otherwise(spoken)


def segment(videos: DataFrame, sentences: DataFrame, shots: DataFrame, settings: Settings) -> DataFrame:
    """Units of all videos with a duration: scenes (level 1) from chapters, clips (level 0) with the scene at their middle.

    unit_no is the unit's number in its video and level; parent_no is that of its scene.
    """
    by_video = shots.groupBy("video_id").agg(sorted_items("t_start", "t_end").alias("shots"))
    rows = speech_density(videos.where("duration_s > 0"), sentences).join(by_video, "video_id", "left")
    silent = F.col("density") < settings.silent_words_per_s
    clips = rows.select("video_id", silent.alias("silent"), F.posexplode(clip_spans(F.col("shots"), F.col("duration_s"), F.col("density"), settings.clips, settings.silent_words_per_s)).alias("unit_no", "s"))
    clips = clips.select("video_id", F.col("unit_no").cast("long").alias("unit_no"), "s.t_start", "s.t_end", F.when(F.col("silent"), SILENT).alias("flags"))
    scenes = rows.select("video_id", F.posexplode(chapter_spans(F.col("chapters"), F.col("duration_s"), settings.scenes)).alias("unit_no", "s"))
    scenes = scenes.select("video_id", F.col("unit_no").cast("long").alias("unit_no"), "s.t_start", "s.t_end")
    placed = containing(clips, (F.col("t_start") + F.col("t_end")) / 2, scenes, "unit_no", "parent_no")
    out = placed.withColumn("level", F.lit(0)).unionByName(scenes.withColumn("level", F.lit(1)).withColumn("flags", F.lit(None).cast("string")).withColumn("parent_no", F.lit(None).cast("long")))
    return out.select("video_id", "level", "unit_no", "t_start", "t_end", "flags", "parent_no")


def units_per_video(units: DataFrame) -> DataFrame:
    return units.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_units"))

