"""What the operators share: the shared folder, tables written there, and bounded slices of Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer document is a step of its own.
SLICE_BYTES = 2_000_000
BATCH_LIMITS = {"spark.sql.execution.arrow.maxBytesPerBatch": "8m", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}

_ROOT = str(Path(__file__).resolve().parent.parent.parent)
_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode where that is unset."""
    for found in (spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()):
        if found:
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own_folder.setdefault("path", tempfile.mkdtemp(prefix="tidemark-"))


@contextmanager
def small_batches(spark: SparkSession):
    """Arrow batches of few bytes while a table is written, as an executor holds several copies of each."""
    old = {k: spark.conf.get(k, None) for k in BATCH_LIMITS}
    try:
        for k, v in BATCH_LIMITS.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables of one run of an operator, written under one folder of the shared folder.

    A written table cuts the lineage and survives lost executors. The last tables are needed until the result has
    been read, so the folder is left to the job that owns the shared folder; `drop` removes earlier ones.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"

    def table(self, df: DataFrame, name: str, *, partition_by: str | None = None, compression: str = "zstd") -> DataFrame:
        with small_batches(self.spark):
            self._write(df, name, partition_by, compression)
        found = self.read(name, df)
        del df
        self.release()
        return found

    def _write(self, df: DataFrame, name: str, partition_by: str | None, compression: str) -> None:
        writer = df.write.mode("overwrite").option("compression", compression)
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(f"{self.path}/{name}")

    def release(self) -> None:
        """Lets Spark delete the shuffle files of what has been written: it does so when the driver has collected the plans."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def read(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """doc_id and the text's UTF-8 bytes; every other column is left behind, so clashing names do no harm."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))


#: The column that names rows; see with_rows().
ROW = "__row"


def _aside(docs: DataFrame) -> str:
    """The name of a column of docs called ROW while rows are named: one that docs lacks."""
    taken, name = {c.lower() for c in docs.columns}, ROW
    while name in taken:
        name += "_"
    return name


def own_columns(docs: DataFrame) -> list[Column]:
    """The columns of docs, to be selected from rows of with_rows(docs)."""
    return [F.col(_aside(docs)).alias(c) if c.lower() == ROW else F.col(f"`{c}`") for c in docs.columns]


def with_rows(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, bool]:
    """docs with a column ROW that differs in all rows, and whether that is doc_id. own_columns() are those of docs.

    It is doc_id where no id is null or repeats; else a number that is written with the row, so it stays the same.
    """
    docs = docs.withColumnsRenamed({c: _aside(docs) for c in docs.columns if c.lower() == ROW})
    own = F.col("doc_id").cast("long")
    if docs.groupBy(own.alias("doc_id")).agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR doc_id IS NULL").isEmpty():
        return docs.withColumn(ROW, own), True
    return scratch.table(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows"), False


def by_row(rows: DataFrame) -> DataFrame:
    """Rows of with_rows() as documents that have the row's name as doc_id."""
    return rows.select(F.col(ROW).alias("doc_id"), "text")


def further_rows(groups: DataFrame, rows: DataFrame, scratch: Scratch, *, largest: bool = False) -> DataFrame:
    """The ROW of all rows of groups (ROW, group) but one: that of the least or largest doc_id; a null id is the last choice."""
    named = scratch.table(groups.join(rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id")), ROW), "grouped")
    if largest:
        stays = F.max_by(ROW, F.struct(F.col("doc_id").isNotNull(), "doc_id", -F.col(ROW)))
    else:
        stays = F.min_by(ROW, F.struct(F.col("doc_id").isNull(), "doc_id", ROW))
    return named.select(ROW).join(named.groupBy("group").agg(stays.alias(ROW)).select(ROW), ROW, "left_anti")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id written as text; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def trim() -> None:
    """Gives memory that a step has freed back to the system, where the allocator would keep it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass


#: What operators keep in a worker process from one task to the next. Workers go on to serve other operators, which drop it.
worker_caches: dict[str, object] = {}


def drop_caches(keep: str = "") -> None:
    for name in [x for x in worker_caches if x != keep]:
        del worker_caches[name]
        trim()


def slices(batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES, keep: str = "") -> Iterator[tuple[list, list[bytes | None], pa.RecordBatch]]:
    """(ids, texts, rows) of at most `most` bytes of text, or one longer document. keep: the cache that the operator uses."""
    drop_caches(keep)
    for batch in batches:
        data = batch.column(batch.schema.get_field_index("text")).to_pylist()
        ids = batch.column(batch.schema.get_field_index("doc_id")).to_pylist()
        first = held = 0
        for at, text in enumerate(data):
            size = len(text) if text else 0
            if at > first and held + size > most:
                yield ids[first:at], data[first:at], batch.slice(first, at - first)
                first, held = at, 0
            held += size
        if first < len(data):
            yield ids[first:], data[first:], batch.slice(first)
        trim()


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow(), with the folder of this package on the workers' path where the driver has it from elsewhere than PYTHONPATH."""
    environment = df.sparkSession.sparkContext.environment
    known = environment.get("PYTHONPATH", "").split(os.pathsep)
    if _ROOT not in known:
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, *known) if x)
    return df.mapInArrow(function, schema)


def partitions_for(spark: SparkSession, rows: int, each: int) -> int:
    """As many partitions as rows ask for, and not fewer than the session's shuffle partitions."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // each))


def _summed(batches):
    total = None
    for batch in batches:
        for x in batch.column(0).to_pylist():
            total = np.frombuffer(x, np.int64) + (0 if total is None else total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["vector"])


def hash_sample(rows: DataFrame, n: int, *key: str) -> DataFrame:
    """All rows if there are n at most, else about n, by a hash of the key: what reaches the driver doesn't grow.

    A best-n query would send n rows of every partition.
    """
    found = rows.count()
    if found <= n:
        return rows
    return rows.where(F.pmod(F.xxhash64(*key), F.lit(1 << 40)) < F.lit(int((1 << 40) * n / found)))


def sum_vectors(rows: DataFrame, length: int, scratch: Scratch, name: str) -> np.ndarray:
    """The sum of packed int64 vectors of one fixed length, 16 to one until few are left for the driver."""
    rows = rows.toDF("vector")
    level, n = 0, rows.count()
    while n > 16:
        n = -(-n // 16)
        rows = scratch.table(map_arrow(rows.repartition(n), _summed, "vector binary"), f"{name}_{(level := level + 1)}")
    return sum((np.frombuffer(bytes(r["vector"]), np.int64) for r in rows.collect()), np.zeros(length, np.int64))
