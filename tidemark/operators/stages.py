"""Which stages ran for which videos, and writing their results so that a reader sees all of a run or nothing."""

from __future__ import annotations

import resource
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from tidemark.schema import schemas


def stage_done(runs: DataFrame, pass_name: str, config_hash: str) -> DataFrame:
    """video_id of the videos that the stage has done with these settings."""
    return runs.where((F.col("pass_name") == pass_name) & (F.col("config_hash") == config_hash) & (F.col("status") == "ok")).select("video_id").distinct()


def pending(videos: DataFrame, runs: DataFrame, pass_name: str, config_hash: str) -> DataFrame:
    """The videos that the stage has still to do: never begun, failed, or begun and never ended."""
    return videos.join(stage_done(runs, pass_name, config_hash), "video_id", "left_anti")


def replace_rows(rows: DataFrame, path: str, by: str, keys: DataFrame | None = None) -> None:
    """Writes rows in place of those with the same values of the partition column; other partitions stay.

    keys: a table of the values (column `by`) that are replaced, so that one without new rows loses its old ones. All
    rows of a key are in one folder; a reader sees the old or the new ones, and one without rows is emptied last. For
    many keys, or readers that must not see half of it, see sources.generations.
    """
    spark = rows.sparkSession
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    if keys is None or not _exists(spark, path):
        return
    held = spark.read.schema(StructType().add(by, StringType())).parquet(path)  # a folder's name as it is: "007" is no number
    written = rows.select(F.col(by).cast("string").alias(by)).distinct()
    stored = held.distinct()
    gone = keys.select(F.col(by).cast("string").alias(by)).distinct().join(written, by, "left_anti").join(stored, by, "left_semi")
    for r in gone.toLocalIterator():  # a folder each, and seldom any
        _delete(spark, f"{path}/{by}={_folder(spark, r[by])}")


def _jvm_path(spark: SparkSession, path: str):
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    found, system = _jvm_path(spark, path)
    return system.exists(found) and any(x.getPath().getName().endswith(".parquet") or x.isDirectory() for x in system.listStatus(found))


def _delete(spark: SparkSession, path: str) -> None:
    found, system = _jvm_path(spark, path)
    system.delete(found, True)


def _folder(spark: SparkSession, value: str) -> str:
    """A partition value as its folder's name writes it."""
    return spark.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(value)


def peak_mb() -> float:
    """The most memory that the driver's Python process has held so far, in MB; executors report theirs to Spark."""
    return resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024


class StageLog:
    """The runs of stages as appended rows; a run counts once its `ok` row is written, after its data."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.schema = spark, path, schemas()["stage_runs"]

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.schema)

    def _add(self, videos: DataFrame, pass_name: str, config_hash: str, status: str, started: float, error: str | None = None) -> None:
        row = videos.select(
            F.xxhash64("video_id", F.lit(pass_name), F.lit(config_hash), F.lit(started), F.lit(status)).alias("id"), "video_id", F.lit(pass_name).alias("pass_name"), F.lit(status).alias("status"),
            F.lit(config_hash).alias("config_hash"), F.lit(started).alias("started_at"), F.lit(None if status == "running" else time.time()).cast("double").alias("ended_at"),
            F.col("rows_out").cast("long").alias("rows_out") if "rows_out" in videos.columns else F.lit(None).cast("long").alias("rows_out"), F.lit(None if status == "running" else peak_mb()).cast("double").alias("peak_mb"),
            F.lit(error[:2000] if error else None).cast("string").alias("error") if error or "error" not in videos.columns else F.col("error"),
        )
        row.write.mode("append").parquet(self.path)

    def run(self, videos: DataFrame, pass_name: str, config_hash: str, work: Callable[[DataFrame], DataFrame], path: str, by: str = "video_id") -> DataFrame:
        """Runs `work` for the pending videos and returns them with `status`, `error` and `rows_out`.

        `work` gives rows with the column `by`. A row whose `error` (if it has that column) isn't null says that its
        video failed: the video is logged as failed and keeps what it had, and the others go on. Anything raised fails
        them all, is logged and raised. Rows of the others replace what was stored of them, also by nothing; then their
        `ok` rows are written. A run that was killed leaves `running` rows only and is done again.

        What a run does is fixed by its `running` rows, which are written first and read again, at any number of videos.
        """
        started = time.time()
        self._add(pending(videos.select("video_id").distinct(), self.read(), pass_name, config_hash), pass_name, config_hash, "running", started)
        own = (F.col("pass_name") == pass_name) & (F.col("config_hash") == config_hash) & (F.col("started_at") == F.lit(started)) & (F.col("status") == "running")
        todo = self.read().where(own).select("video_id")
        if todo.isEmpty():
            return todo.select("video_id", F.lit("ok").alias("status"), F.lit(None).cast("string").alias("error"), F.lit(0).cast("long").alias("rows_out"))
        staged = f"{self.path}_staged/{started:.6f}"
        try:
            made = work(todo)
            made = made if "error" in made.columns else made.withColumn("error", F.lit(None).cast("string"))
            made.withColumn("error", F.col("error").cast("string")).write.mode("overwrite").parquet(staged)  # so that `work` runs once
            made = self.spark.read.schema(made.schema).parquet(staged)
            counts = made.groupBy(F.col(by).cast("string").alias("video_id")).agg(F.max("error").alias("error"), F.count(F.lit(1)).alias("n"))
            ended = todo.join(counts, "video_id", "left").select("video_id", F.substring("error", 1, 2000).alias("error"), F.when(F.col("error").isNull(), F.coalesce("n", F.lit(0))).alias("rows_out"))
            good = ended.where("error IS NULL")
            rows = made.drop("error").join(good.select(F.col("video_id").alias("_video")), F.col(by).cast("string") == F.col("_video"), "left_semi")
            replace_rows(rows, path, by, good.select(F.col("video_id").alias(by)))
            self._add(ended.where("error IS NOT NULL"), pass_name, config_hash, "failed", started)
            self._add(good, pass_name, config_hash, "ok", started)
        except Exception as e:
            self._add(todo, pass_name, config_hash, "failed", started, f"{type(e).__name__}: {e}")
            _delete(self.spark, staged)
            raise
        _delete(self.spark, staged)
        ran = (F.col("pass_name") == pass_name) & (F.col("config_hash") == config_hash) & (F.col("started_at") == F.lit(started)) & F.col("status").isin("ok", "failed")
        return self.read().where(ran).select("video_id", "status", "error", "rows_out")
