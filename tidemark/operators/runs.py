"""Stages whose rows and log are one commit: what operators.stages does by folders, on a store of generations."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemark.operators.stages import pending
from tidemark.schema import schemas
from tidemark.sources.generations import Add, Put, Replace, Store

LOG = "stage_runs"


class StageRuns:
    """The log of stages (table `stage_runs` of the store) and their results, each by a key.

    A run's rows replace those of its videos and its `ok` rows come in the same commit, so no reader finds a video done
    whose rows are old, nor rows of a run that isn't logged. What is replaced are rows by hash buckets and a list of
    keys: there is no folder for each video, and a video's new generation without rows needs nothing deleted.
    """

    def __init__(self, store: Store):
        self.store, self.spark, self.schema = store, store.spark, schemas()[LOG]

    def read(self, version: int | None = None) -> DataFrame:
        try:
            return self.store.read(LOG, version=version)
        except KeyError:
            return self.spark.createDataFrame([], self.schema)

    def _rows(self, videos: DataFrame, pass_name: str, config_hash: str, started: float) -> DataFrame:
        """Log rows of videos (video_id, status, error, rows_out, peak_mb)."""
        ended = F.when(F.col("status") != "running", F.lit(time.time()))
        return videos.select(
            F.xxhash64("video_id", F.lit(pass_name), F.lit(config_hash), F.lit(started), "status").alias("id"), "video_id", F.lit(pass_name).alias("pass_name"), F.col("status").cast("string").alias("status"), F.lit(config_hash).alias("config_hash"),
            F.lit(started).alias("started_at"), ended.alias("ended_at"), F.col("rows_out").cast("long").alias("rows_out"), F.col("peak_mb").cast("double").alias("peak_mb"), F.substring(F.col("error").cast("string"), 1, 2000).alias("error"),
        )

    def run(self, videos: DataFrame, pass_name: str, config_hash: str, work: Callable[[DataFrame], DataFrame | dict[str, DataFrame]], table: str | None = None, by: str = "video_id") -> DataFrame:
        """Runs `work` for the pending videos and returns their log rows (video_id, status, error, rows_out, peak_mb).

        `work` gives the rows of `table`, or a dictionary of several tables' rows, each with the column `by`. A row whose
        `error` (if it has that column) isn't null says that its video failed: it is logged as failed, keeps what it had
        in all tables, and the others go on. Anything raised fails them all, is logged and raised. A column `_peak_mb` of
        the rows, if there is one, is the memory of the process that made them; the log has a video's greatest. rows_out
        counts the rows of all tables.

        All tables and the log are one commit. A run that was killed leaves `running` rows and is done again; Conflict is
        raised if another commit comes between, with nothing changed, and the videos are still pending.
        """
        started = time.time()
        todo = pending(videos.select("video_id").distinct(), self.read(), pass_name, config_hash)
        blank = todo.withColumns({"status": F.lit("running"), "error": F.lit(None), "rows_out": F.lit(None), "peak_mb": F.lit(None)})
        begun = self.store.commit({LOG: Add(self._rows(blank, pass_name, config_hash, started))})
        own = (F.col("pass_name") == pass_name) & (F.col("config_hash") == config_hash) & (F.col("started_at") == F.lit(started))
        todo = self.read(begun).where(own & (F.col("status") == "running")).select("video_id")
        shown = ("video_id", "status", "error", "rows_out", "peak_mb")
        if todo.isEmpty():
            return self.read(begun).where(own).select(*shown)
        staged = Store(self.spark, f"{self.store.root}/_staged/{uuid.uuid4().hex}")
        try:
            made = work(todo)
            made = made if isinstance(made, dict) else {table: made}
            plain, seen = {}, {name: Observation(name) for name in made}
            for name, rows in made.items():
                extra = {c: F.lit(None).cast(t) for c, t in (("error", "string"), ("_peak_mb", "double")) if c not in rows.columns}
                plain[name] = rows.withColumns(extra).observe(seen[name], F.count(F.lit(1)).alias("rows"), F.count("error").alias("errors"))
            staged.commit({name: Put(rows) for name, rows in plain.items()})  # so that `work` runs once
            made = {name: staged.read(name) for name in made}
            said = [x.select(F.col(by).cast("string").alias("_by"), F.substring(F.col("error").cast("string"), 1, 2000).alias("error"), "_peak_mb") for x in made.values()]
            counts = reduce(DataFrame.unionByName, said).groupBy("_by").agg(F.max("error").alias("error"), F.count(F.lit(1)).alias("n"), F.max("_peak_mb").alias("peak_mb"))
            ended = todo.join(counts, todo["video_id"] == counts["_by"], "left")
            ended = ended.select("video_id", F.when(F.col("error").isNull(), "ok").otherwise("failed").alias("status"), "error", F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).alias("rows_out"), "peak_mb")
            good, failing = ended.where("status = 'ok'").select("video_id"), any(x.get["errors"] for x in seen.values())
            changes: dict[str, Put | Add | Replace] = {}
            for name, x in made.items():
                rows = x.drop("error", "_peak_mb")
                if failing:  # else all rows are of good videos, and none is looked at again
                    rows = rows.join(good, rows[by].cast("string") == good["video_id"], "left_semi")
                changes[name] = Replace(rows, by, good)
            version = self.store.commit(changes | {LOG: Add(self._rows(ended, pass_name, config_hash, started))})
        except Exception as e:
            failed = todo.withColumns({"status": F.lit("failed"), "error": F.lit(f"{type(e).__name__}: {e}"), "rows_out": F.lit(None), "peak_mb": F.lit(None)})
            self.store.commit({LOG: Add(self._rows(failed, pass_name, config_hash, started))})
            raise
        finally:
            staged.vacuum(0)
        return self.read(version).where(own & (F.col("status") != "running")).select(*shown)
