"""Scene boundaries from frames: where neighbouring frames differ, found across partitions.

Frames are made smaller where they are read. A frame meets the one before it in a run of frames that has the last frame
of the run before it too, so a video's frames are dealt to many tasks. Cuts that come too soon after the last one don't
count, which depends on where that was: they are greedy groups of operators.timelines.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.timelines import CHUNK, Rule, greedy_groups

#: The mean difference that is a cut, frames of a scene at least, and the width that frames are made
#: smaller to where no factor is given.
THRESHOLD, LEAST_FRAMES, WIDTH = 27.0, 15, 256
#: Frames of a run.
RUN = 512


def hsv(pixels: np.ndarray) -> np.ndarray:
    """Hue (0 to 180), saturation and value (0 to 255) of red, green and blue bytes, one plane after the other."""
    x = pixels.astype(np.float64)
    r, g, b = x[..., 0], x[..., 1], x[..., 2]
    high, low = x.max(axis=-1), x.min(axis=-1)
    span = high - low
    safe = np.where(span > 0, span, 1)
    hue = np.where(high == r, 60 * (g - b) / safe, np.where(high == g, 120 + 60 * (b - r) / safe, 240 + 60 * (r - g) / safe))
    hue = np.where(span > 0, np.where(hue < 0, hue + 360, hue), 0) / 2
    return np.rint(np.stack([hue, np.where(high > 0, 255 * span / np.where(high > 0, high, 1), 0), high])).astype(np.uint8)


def smaller(content: bytes, height: int, width: int, downscale: int | None) -> np.ndarray:
    """A frame's pixels, every n-th in both directions."""
    step = downscale or max(1, width // WIDTH)
    return np.frombuffer(content, np.uint8).reshape(height, width, 3)[::step, ::step]


def difference(a: np.ndarray, b: np.ndarray) -> float:
    """The mean over hue, saturation and value of the mean difference of two frames' pixels; frames of other sizes differ wholly."""
    if a.shape != b.shape:
        return 255.0
    return float(np.abs(a.astype(np.int16) - b.astype(np.int16)).reshape(3, -1).mean(axis=1).mean())


def frame_scores(frames: DataFrame, *, downscale: int | None = None, run: int = RUN) -> DataFrame:
    """video_id, frame_no, t, score: how much a frame (video_id, frame_no, t, height, width, pixels: RGB bytes) differs
    from the one before it; 0 for the first. Frames of a video have different numbers; some may be missing. A frame
    without pixels has no score."""

    def made_small(batches):
        for batch in batches:
            rows = batch.to_pydict()
            planes = [hsv(smaller(p, h, w, downscale)) if p is not None else None for p, h, w in zip(rows["pixels"], rows["height"], rows["width"], strict=True)]
            columns = [*(batch.column(c) for c in ("video_id", "frame_no", "t")), pa.array([None if x is None else x.shape[1] for x in planes], pa.int32()), pa.array([None if x is None else x.tobytes() for x in planes], pa.binary())]
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else x.combine_chunks() for x in columns], names=["video_id", "frame_no", "t", "height", "planes"])

    small = frames.select(F.col("video_id").cast("string").alias("video_id"), F.col("frame_no").cast("long").alias("frame_no"), F.col("t").cast("double").alias("t"), "height", "width", "pixels").mapInArrow(made_small, "video_id string, frame_no long, t double, height int, planes binary")
    own = small.withColumns({"run": F.floor(F.col("frame_no") / run), "own": F.lit(True)})
    # The run's last frame goes to the next one as well. Runs without frames between are few and short, or none.
    last = own.groupBy("video_id", "run").agg(F.max("frame_no").alias("frame_no"))
    runs = last.select("video_id", "run")
    following = runs.join(runs.select("video_id", F.col("run").alias("_then")), "video_id").where("_then > run").groupBy("video_id", "run").agg(F.min("_then").alias("_then"))
    carried = own.join(last, ["video_id", "run", "frame_no"], "left_semi").join(following, ["video_id", "run"]).select("video_id", "frame_no", "t", "height", "planes", F.col("_then").alias("run"), F.lit(False).alias("own"))
    dealt = own.unionByName(carried).repartition("video_id", "run").sortWithinPartitions("video_id", "run", "frame_no")

    def scored(batches):
        at, before = None, None
        for batch in batches:
            out = []
            for video, no, t, height, planes, which, mine in zip(*(batch.column(c).to_pylist() for c in ("video_id", "frame_no", "t", "height", "planes", "run", "own")), strict=True):
                if (video, which) != at:
                    at, before = (video, which), None
                now = None if planes is None else np.frombuffer(planes, np.uint8).reshape(3, height, -1) if height else None
                if mine:
                    out.append((video, no, t, None if now is None else 0.0 if before is None else difference(before, now)))
                before = before if now is None else now
            columns = list(zip(*out, strict=True)) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.float64(), pa.float64()), strict=True)], names=["video_id", "frame_no", "t", "score"])

    return dealt.mapInArrow(scored, "video_id string, frame_no long, t double, score double")


def scene_boundaries(scores: DataFrame, *, threshold: float = THRESHOLD, least_frames: int = LEAST_FRAMES, chunk: int = CHUNK) -> DataFrame:
    """video_id, t_start, t_end of the scenes of videos that have a cut, from frame_scores(): a frame with a score of the
    threshold or more begins a scene if the one before it has least_frames; the last scene ends with the last frame's t.
    Videos without a cut have no rows, as segment.close_shots() takes them."""
    rows = scores.select("video_id", F.col("t").alias("t_start"), F.col("t").alias("t_end"), "frame_no", F.coalesce(F.col("score") >= threshold, F.lit(False)).alias("_cut"))
    groups = greedy_groups(rows, Rule(after=False, min_items=least_frames), ["t_start", "frame_no"], ends=F.col("_cut"), chunk=chunk)
    scenes = groups.groupBy("video_id", "group_no").agg(F.min("t_start").alias("t_start"), F.max("t_start").alias("last"))
    then = scenes.select("video_id", (F.col("group_no") - 1).alias("group_no"), F.col("t_start").alias("next"))
    several = scenes.where("group_no = 1").select("video_id")
    return scenes.join(then, ["video_id", "group_no"], "left").join(several, "video_id", "left_semi").select("video_id", "t_start", F.coalesce("next", "last").alias("t_end"))
