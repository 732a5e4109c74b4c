"""Copies of a corpus's files by tasks, with checksums.

Files are listed by Spark and dealt to tasks by size; each task streams its files from one file system to the other. A
file is written under a name of its own and renamed when its checksum is known. The manifest of names, lengths and
checksums is written last, so a copy without one isn't whole, and later runs copy only what is missing or damaged.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from fnmatch import fnmatch
from urllib.parse import unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.files import PRIVATE
from tidemark.sources.generations import Put, Store

#: Bytes that a task copies, about, and that it holds at a time.
TASK_BYTES, PART_BYTES = 1 << 30, 8 << 20
MANIFEST = "name string, length long, sha256 string"
FOLDER = "_manifest"


def _opened(root: str, name: str = "") -> tuple[fs.FileSystem, str]:
    """The file system of a root, and the path of a file below it, whose name is no part of the URL."""
    local = re.match(r"(?:file:(?://)?)?(/.*)", root)
    system, path = (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(root)
    return system, f"{path.rstrip('/')}/{name}"


def _checksum(system: fs.FileSystem, path: str) -> tuple[int, str] | None:
    """Length and sha256 of a file; None if there is none."""
    if system.get_file_info(path).type != fs.FileType.File:
        return None
    digest, size = hashlib.sha256(), 0
    with system.open_input_stream(path) as stream:
        while part := stream.read(PART_BYTES):
            digest.update(part)
            size += len(part)
    return size, digest.hexdigest()


def _copy(source: str, target: str, name: str) -> tuple[int, str]:
    (own, at), (to, there) = _opened(source, name), _opened(target, name)
    part, digest, size = f"{there}.{uuid.uuid4().hex}.part", hashlib.sha256(), 0
    to.create_dir(there.rsplit("/", 1)[0], recursive=True)
    try:
        with own.open_input_stream(at) as read, to.open_output_stream(part) as write:
            while block := read.read(PART_BYTES):
                digest.update(block)
                size += len(block)
                write.write(block)
        if _checksum(to, part) != (size, digest.hexdigest()):
            raise OSError(f"{name} was not written as it was read")
        to.move(part, there)
    except BaseException:
        if to.get_file_info(part).type == fs.FileType.File:
            to.delete_file(part)
        raise
    return size, digest.hexdigest()


def listed(spark: SparkSession, root: str, *, patterns: tuple[str, ...] = ("*",), ignored: tuple[str, ...] = PRIVATE) -> DataFrame:
    """name, length of the files below a folder whose path or name matches a pattern and of which no part is ignored."""
    base = _opened(root)[1].rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    below = lambda path: F.element_at(F.split(path, F.lit(f"\\Q{base}/\\E"), 2), -1)
    # Spark reads no empty files, but its list of files, which the driver holds in any scan, has them.
    every = spark.createDataFrame([(unquote(x),) for x in files.inputFiles()], "path string").select(below("path").alias("name"))
    full = files.select(below("path").alias("name"), "length")
    named = full.unionByName(every.join(full, "name", "left_anti").withColumn("length", F.lit(0).cast("long")))

    @F.udf(returnType="boolean", useArrow=False)
    def chosen(x: str) -> bool:  # a path for each file
        return not any(fnmatch(p, i) for p in (x, *x.split("/")) for i in ignored) and any(fnmatch(x, p) or fnmatch(x.rsplit("/", 1)[-1], p) for p in patterns)

    return named.where(chosen("name"))


def _dealt(files: DataFrame, task_bytes: int) -> DataFrame:
    """Files (name, length) in partitions of about task_bytes. They are added up in groups by a hash, so no task has all names."""
    n = max(1, -(-(files.agg(F.sum("length")).collect()[0][0] or 0) // (64 * task_bytes)))
    grouped = files.withColumn("group", F.pmod(F.xxhash64("name"), F.lit(n)))
    upto = F.sum(F.col("length") + 1).over(Window.partitionBy("group").orderBy(F.desc("length"), "name"))
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return grouped.withColumn("task", F.floor(upto / (task_bytes + 1))).repartition(max(parts, 64 * n if n > 1 else parts), "group", "task").select("name", "length")


def copy_files(spark: SparkSession, source: str, target: str, *, patterns: tuple[str, ...] = ("*",), ignored: tuple[str, ...] = PRIVATE, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Copies what the target lacks or has otherwise than its manifest says; returns the new manifest's rows with `copied`.

    File systems are those that pyarrow knows, by URL, or paths that all machines share. A target's other files stay.
    """
    files = listed(spark, source, patterns=patterns, ignored=ignored)
    manifest = Store(spark, f"{target.rstrip('/')}/{FOLDER}")
    known = manifest.read("files") if manifest.version() else spark.createDataFrame([], MANIFEST)
    known = known.select("name", F.col("length").alias("was"), F.col("sha256").alias("sum"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name, was, known_sum in zip(*(batch.column(c).to_pylist() for c in ("name", "was", "sum")), strict=True):
                held = _checksum(*_opened(target, name)) if known_sum else None
                own = _checksum(*_opened(source, name)) if held == (was, known_sum) and held else None
                if held is not None and own == held:
                    rows.append((name, *held, False))
                else:
                    rows.append((name, *_copy(source, target, name), True))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(list(zip(*rows, strict=True)) or [[]] * 4, (pa.string(), pa.int64(), pa.string(), pa.bool_()), strict=True)], names=["name", "length", "sha256", "copied"])

    source, target = source.rstrip("/"), target.rstrip("/")
    made = _dealt(files, task_bytes).join(known, "name", "left").select("name", "was", "sum").mapInArrow(work, f"{MANIFEST}, copied boolean")
    base = manifest.version()
    version = manifest.commit({"last": Put(made)}, base=base)  # the copying runs here, once
    done = manifest.read("last", version=version)
    others = known.join(done, "name", "left_anti").select("name", F.col("was").alias("length"), F.col("sum").alias("sha256"))
    manifest.commit({"files": Put(done.select("name", "length", "sha256").unionByName(others))}, base=version)
    return done


def damaged(spark: SparkSession, target: str) -> DataFrame:
    """name, reason of the manifest's files that are missing or have other bytes."""
    target = target.rstrip("/")
    files = Store(spark, f"{target}/{FOLDER}").read("files")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, length, digest in zip(*(batch.column(c).to_pylist() for c in ("name", "length", "sha256")), strict=True):
                held = _checksum(*_opened(target, name))
                if held != (length, digest):
                    found.append((name, "missing" if held is None else "other length" if held[0] != length else "other bytes"))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in range(2)], names=["name", "reason"])

    return files.repartition("name").mapInArrow(work, "name string, reason string")
