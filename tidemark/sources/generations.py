"""Tables of which a reader sees one commit whole, and replacing rows by key without rewriting what stays.

A commit writes what is new into folders of its own and then one small file that names all folders that count, under the
next number, by a rename that fails if another commit took the number. The newest such file is what readers open. A commit
that is killed leaves folders that no file names; a reader that has opened an older one goes on reading its folders until
vacuum() takes them.

Rows replaced by key are not touched: the new generation lists the keys, and reading leaves out the older rows that have
them (an anti join), until compact() writes what is left as one generation. Rows lie in a fixed number of buckets by a
hash of the key, so neither the number of keys nor their spelling decides the folders; keys keep their type and value.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

#: Names of the columns that rows carry in files.
LAYER, BUCKET = "__layer", "__bucket"
BUCKETS = 32
_own: dict[str, str] = {}


class Conflict(RuntimeError):
    """Another commit came between; nothing of this one counts. Read again and commit again."""


@dataclass(frozen=True)
class Put:
    """The whole table anew."""

    rows: DataFrame


@dataclass(frozen=True)
class Add:
    """Rows besides those that are there."""

    rows: DataFrame


@dataclass(frozen=True)
class Replace:
    """Rows in place of all that have a key (column `by`) of `keys`; without keys, of those that rows themselves have. A
    null is a key like others."""

    rows: DataFrame
    by: str
    keys: DataFrame | None = None


@dataclass
class _State:
    version: int = 0
    tables: dict[str, dict] = field(default_factory=dict)


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only in local mode where that is unset."""
    for found in (spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()):
        if found:
            return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _own.setdefault("path", tempfile.mkdtemp(prefix="tidemark-"))


def bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Store:
    """Tables under the folder `root`. Renaming a file must be atomic there, as on HDFS and local disks."""

    def __init__(self, spark: SparkSession, root: str, *, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self._jvm = spark.sparkContext._jvm
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._path("").getFileSystem(conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(x.getPath().getName() for x in self._files.listStatus(path)) if self._files.exists(path) else []

    # --- commits --------------------------------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return [int(x[:-5]) for x in self._names("_commits") if x.endswith(".json") and x[:-5].isdigit()]

    def version(self) -> int:
        """The number of the newest commit; 0 if there is none."""
        return max(self.versions(), default=0)

    def _state(self, version: int | None = None) -> _State:
        version = self.version() if version is None else version
        if not version:
            return _State()
        stream = self._files.open(self._path(f"_commits/{version:012d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return _State(version, json.loads(text))

    def _publish(self, state: _State) -> None:
        new = self._path(f"_commits/new-{uuid.uuid4().hex}")
        out = self._files.create(new, False)
        out.write(bytearray(json.dumps(state.tables), "utf-8"))
        out.close()
        try:
            none = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
            options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
            options[0] = none
            self._context.rename(new, self._path(f"_commits/{state.version:012d}.json"), options)
        except Py4JJavaError as e:
            self._files.delete(new, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
                raise Conflict(f"commit {state.version} exists") from None
            raise

    def commit(self, changes: dict[str, Put | Add | Replace], *, base: int | None = None) -> int:
        """All changes at once, on top of the commit `base` (the newest one); returns the new commit's number.

        Raises Conflict, with nothing changed, if another commit came after the base.
        """
        state = self._state(base)
        version, tables, written = state.version + 1, dict(state.tables), []
        try:
            for name, change in changes.items():
                tables[name] = self._changed(tables.get(name), name, change, version, written)
            self._publish(_State(version, tables))
        except BaseException:
            for folder in written:
                self._files.delete(self._path(folder), True)
            raise
        return version

    def _changed(self, held: dict | None, name: str, change: Put | Add | Replace, version: int, written: list[str]) -> dict:
        by = change.by if isinstance(change, Replace) else (held or {}).get("by")
        if held and held.get("by") and by != held["by"]:
            raise ValueError(f"rows of {name} are replaced by {held['by']}")
        if held and not isinstance(change, Put) and StructType.fromJson(held["schema"]).simpleString() != change.rows.schema.simpleString():
            raise ValueError(f"{name} has other columns or types")
        rows, folder = change.rows.withColumn(LAYER, F.lit(version).cast("long")), f"{name}/{version:012d}-{uuid.uuid4().hex[:8]}"
        written.append(folder)
        if isinstance(change, Replace) and change.keys is None:  # what the rows have is read from what was written
            self._write(rows, f"{folder}/rows", by)
            keys = self.spark.read.schema(self._file_schema(change.rows.schema, by)).parquet(f"{self.root}/{folder}/rows").select(by)
        else:
            self._write(rows, f"{folder}/rows", by)
            keys = change.keys.select(F.col(change.keys.columns[0]).cast(change.rows.schema[by].dataType).alias(by)) if isinstance(change, Replace) else None
        old = [] if held is None or isinstance(change, Put) else held["layers"]
        gone = None
        if keys is not None and old:
            gone = f"{folder}/gone"
            keys.distinct().withColumn(LAYER, F.lit(version).cast("long")).write.parquet(f"{self.root}/{gone}")
        kept = {"rows": f"{folder}/rows", "gone": gone, "buckets": self.buckets if by else None}
        return {"by": by, "schema": change.rows.schema.jsonValue(), "layers": [*old, kept]}

    def _write(self, rows: DataFrame, folder: str, by: str | None) -> None:
        if by:
            # Buckets are dealt so that a large one, a key with a third of all rows say, is split over several tasks.
            rows.withColumn(BUCKET, bucket(by, self.buckets)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.root}/{folder}")
        else:
            rows.write.parquet(f"{self.root}/{folder}")

    def _file_schema(self, schema: StructType, by: str | None) -> StructType:
        out = StructType(list(schema.fields)).add(LAYER, LongType())
        return out.add(BUCKET, IntegerType()) if by else out

    # --- reading --------------------------------------------------------------------------------------------------

    def read(self, name: str, *, version: int | None = None, only: list | None = None) -> DataFrame:
        """The rows of a table as of a commit. only: values of its key; buckets without them aren't opened.

        Raises KeyError if the commit has no such table.
        """
        held = self._state(version).tables[name]
        by, schema, layers = held["by"], StructType.fromJson(held["schema"]), held["layers"]

        def opened(own: list[dict]) -> DataFrame:
            rows = self.spark.read.schema(self._file_schema(schema, by)).option("basePath", self.root)
            rows = rows.parquet(*(f"{self.root}/{x['rows']}" for x in own)) if len(own) == 1 else _union([rows.parquet(f"{self.root}/{x['rows']}") for x in own])
            if only is None or by is None:
                return rows
            wanted = rows.where(F.col(by).isin(only))
            numbers = {x["buckets"] for x in own}
            if len(numbers) > 1:
                return wanted
            places = self.spark.createDataFrame([(x,) for x in only], StructType().add(schema[by])).select(bucket(by, numbers.pop()).alias("b")).distinct().collect()
            return wanted.where(F.col(BUCKET).isin([r["b"] for r in places]))

        rows = opened(layers)
        if any(x["gone"] for x in layers):
            gone = _union([self.spark.read.schema(StructType().add(schema[by]).add(LAYER, LongType())).parquet(f"{self.root}/{x['gone']}") for x in layers if x["gone"]])
            last = gone.groupBy(F.col(by).alias("__by")).agg(F.max(LAYER).alias("__until"))
            rows = rows.join(last, rows[by].eqNullSafe(F.col("__by")) & (rows[LAYER] < F.col("__until")), "left_anti")
        return rows.select(*schema.names)

    # --- upkeep ---------------------------------------------------------------------------------------------------

    def compact(self, name: str) -> int:
        """The table's rows as one generation, in a commit; a Conflict leaves all as it is."""
        state = self._state()
        by, rows = state.tables[name]["by"], self.read(name, version=state.version)
        folder, written = f"{name}/{state.version + 1:012d}-{uuid.uuid4().hex[:8]}", []
        try:
            written.append(folder)
            self._write(rows.withColumn(LAYER, F.lit(state.version + 1).cast("long")), f"{folder}/rows", by)
            table = {**state.tables[name], "layers": [{"rows": f"{folder}/rows", "gone": None, "buckets": self.buckets if by else None}]}
            self._publish(_State(state.version + 1, {**state.tables, name: table}))
        except BaseException:
            for x in written:
                self._files.delete(self._path(x), True)
            raise
        return state.version + 1

    def vacuum(self, keep: int = 1) -> int:
        """Deletes commits before the last `keep` and the folders that no commit left names; returns how many folders.

        For when nothing commits: the folders of a commit on its way are named by none yet.
        """
        versions = self.versions()
        stay = versions[max(0, len(versions) - keep) :]
        named = {x["rows"].rsplit("/", 1)[0] for v in stay for t in self._state(v).tables.values() for x in t["layers"]}
        for v in versions[: len(versions) - len(stay)]:
            self._files.delete(self._path(f"_commits/{v:012d}.json"), False)
        gone = [f"{t}/{x}" for t in self._names("") if not t.startswith("_") for x in self._names(t) if f"{t}/{x}" not in named]
        for folder in gone:
            self._files.delete(self._path(folder), True)
        return len(gone)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for x in frames[1:]:
        out = out.unionByName(x)
    return out
