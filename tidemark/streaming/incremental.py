"""Stages over videos as they arrive: each micro-batch runs what its videos still need, so a batch run twice does no harm."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.runs import StageRuns
from tidemark.operators.stages import StageLog
from tidemark.sources.generations import Store


def follow(
    spark: SparkSession, source: str, schema: str, *, pass_name: str, config_hash: str, work: Callable[[DataFrame], DataFrame], out: str, log: str | Store, checkpoint: str
) -> StreamingQuery:
    """Runs the stage for what is new in a folder of Parquet files and ends when it has caught up.

    log: the folder of the log, with `out` that of the rows; or a store that has both, with `out` the table's name.
    """

    def batch(rows: DataFrame, _: int) -> None:
        runs = StageRuns(log) if isinstance(log, Store) else StageLog(spark, log)
        runs.run(rows, pass_name, config_hash, lambda todo: work(rows.join(todo, "video_id", "left_semi")), out)

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
