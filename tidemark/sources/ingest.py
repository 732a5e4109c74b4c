"""Ingest in one run: what a fetcher gives for each URL becomes videos and shots, in the commit of its log."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.media import probe_info
from tidemark.operators.runs import StageRuns
from tidemark.operators.scenes import LEAST_FRAMES, THRESHOLD, frame_scores, scene_boundaries
from tidemark.operators.segment import close_shots
from tidemark.settings import Settings
from tidemark.sources.generations import Put, Store

_INFO = "struct<id: string, title: string, duration: double, chapters: array<struct<start_time: double, end_time: double, title: string>>>"


def ingest_videos(
    store: Store, urls: DataFrame, config_hash: str, fetch: Callable[[str], dict], *, frames: Callable[[DataFrame], DataFrame] | None = None, settings: Settings | None = None, threshold: float = THRESHOLD, least_frames: int = LEAST_FRAMES
) -> DataFrame:
    """Fetches the URLs (column `url`) that aren't done and writes `videos` and `shots`; returns the run's log rows, whose
    video_id is the URL.

    fetch gives `info` (JSON-like, as a manifest's line) and `probe` (as a probe's result) for a URL, or raises: that URL
    fails alone, as does one whose file has no video stream. frames gives the frames (operators.scenes) of rows (video_id,
    url); without it, or without a cut, a video is one shot. A video's tables and its log change together or not at all.
    """
    settings = settings or Settings()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for url in batch.column(0).to_pylist():
                try:
                    got = fetch(url)
                    rows.append((url, json.dumps(got["info"]), json.dumps(got["probe"]), None))
                except Exception as e:  # one bad item mustn't end the run
                    rows.append((url, None, None, f"{type(e).__name__}: {e}"[:2000]))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], names=["video_id", "info", "probe", "error"])

    def work(todo: DataFrame) -> dict[str, DataFrame]:
        kept = Store(store.spark, f"{store.root}/_fetched/{config_hash}")
        kept.commit({"fetched": Put(todo.mapInArrow(each, "video_id string, info string, probe string, error string"))})
        fetched = kept.read("fetched").withColumns({"i": F.from_json("info", _INFO), "m": probe_info(F.col("probe"), settings.vfr_tolerance_fps)})
        error = F.when(F.col("error").isNull() & F.col("m").isNull(), "ValueError: file has no video stream").otherwise(F.col("error"))
        rows = fetched.withColumns({"error": error, "duration_s": F.coalesce("m.duration_s", "i.duration")})
        videos = rows.select("video_id", F.col("i.id").alias("id"), F.col("i.title").alias("title"), "duration_s", "m.fps", "m.width", "m.is_variable_frame_rate", "m.has_audio", F.to_json("i.chapters").alias("chapters"), "error")
        good = rows.where("error IS NULL").select("video_id", F.col("video_id").alias("url"), "duration_s")
        if frames is None:
            bounded = good.withColumn("b", F.lit(None).cast("array<struct<t_start: double, t_end: double>>"))
        else:
            found = scene_boundaries(frame_scores(frames(good.select("video_id", "url"))), threshold=threshold, least_frames=least_frames)
            bounded = good.join(found.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("t_start", "t_end"))).alias("b")), "video_id", "left")
        shots = bounded.select("video_id", F.posexplode(close_shots(F.col("b"), F.col("duration_s"))).alias("shot_no", "s")).select("video_id", "shot_no", "s.t_start", "s.t_end")
        return {"videos": videos, "shots": shots}

    return StageRuns(store).run(urls.select(F.col("url").cast("string").alias("video_id")).where("video_id IS NOT NULL"), "ingest", config_hash, work)

