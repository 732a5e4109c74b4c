"""Files at the edges: manifests, probe results, waveforms, models that run on files, and partial copies of a corpus."""

from __future__ import annotations

import io
import json
import resource
import subprocess
import wave
from collections.abc import Callable, Iterator
from fnmatch import fnmatch

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.resource import ResourceProfile
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.media import probe_info
from tidemark.operators.stages import StageLog


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """video_id, url, title, duration_s, chapters from one JSON object a line; broken lines are rows with an `error`."""
    schema = "id string, webpage_url string, title string, duration double, chapters array<struct<start_time: double, end_time: double, title: string>>, _corrupt string"
    rows = spark.read.schema(schema).option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.select(F.col("id").alias("video_id"), F.col("webpage_url").alias("url"), "title", F.col("duration").alias("duration_s"), "chapters", F.col("_corrupt").alias("error"))


def read_probes(spark: SparkSession, path: str, tolerance_fps: float) -> DataFrame:
    """path and media facts of each probe result, a JSON file each; `error` where a file has no video stream."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), probe_info(F.col("value"), tolerance_fps).alias("info"))
    return rows.select("path", "info.*", F.when(F.col("info").isNull(), "file has no video stream").alias("error"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names a table's files by their paths, sizes and times of change; no content is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    each = F.xxhash64("path", "length", "modificationTime")
    n, low, high = listed.agg(F.count(F.lit(1)), F.bit_xor(each), F.sum(F.pmod(each, F.lit(1_000_000_007)))).collect()[0]
    return f"{n:x}-{(low or 0) & 0xFFFFFFFFFFFFFFFF:016x}-{high or 0:x}"


def decode_waveform(content: bytes, rate: int) -> np.ndarray:
    """Mono samples from -1 to 1 of 16-bit PCM at the rate, by linear interpolation where the file has another."""
    with wave.open(io.BytesIO(content)) as f:
        if f.getsampwidth() != 2:
            raise ValueError(f"16-bit PCM is needed, not {8 * f.getsampwidth()}-bit")
        own, samples = f.getframerate(), np.frombuffer(f.readframes(f.getnframes()), "<i2").reshape(-1, f.getnchannels())
    mono = (samples.astype(np.float32) / 32768).mean(axis=1)
    if own == rate or not len(mono):
        return mono
    at = np.arange(int(len(mono) * rate / own)) * (own / rate)
    return np.interp(at, np.arange(len(mono)), mono).astype(np.float32)


def read_waveforms(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """path, samples, error of each wav file; a file that can't be read has an error and no samples."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    samples, error = decode_waveform(content, rate), None
                except (ValueError, EOFError, wave.Error) as e:
                    samples, error = None, f"{type(e).__name__}: {e}"[:2000]
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([samples], pa.list_(pa.float32())), pa.array([error], pa.string())], names=["path", "samples", "error"])

    return read_files(spark, path, "*.wav").select("path", "content").mapInArrow(decode, "path string, samples array<float>, error string")


def run_model(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str, *, profile: ResourceProfile | None = None, measure: bool = False) -> DataFrame:
    """Rows through a model that is loaded once for each task, and gone with it before the next task's.

    A batch that fails is halved until the rows that fail stand alone: those have the input's values of the model's
    columns and an `error`, and all others their results. schema: the model's columns; `error` is added. profile: what an
    executor and a task of this step need, an accelerator for instance. measure: add `_peak_mb`, the most memory the
    process that made a row has held so far, which operators.runs logs.
    """
    names = [x.strip().split()[0] for x in schema.split(",")]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()
        for batch in batches:
            waiting = [batch]
            while waiting:
                own = waiting.pop()
                try:
                    made = model(own).assign(error=None)[[*names, "error"]]
                except Exception as e:  # one bad row mustn't end the run
                    if len(own) > 1:
                        half = len(own) // 2
                        waiting += [own.iloc[half:], own.iloc[:half]]
                        continue
                    made = own.reindex(columns=names).assign(error=f"{type(e).__name__}: {e}"[:2000])
                yield made.assign(_peak_mb=resource.getrusage(resource.RUSAGE_SELF).ru_maxrss / 1024) if measure else made

    return rows.mapInPandas(work, f"{schema}, error string" + (", _peak_mb double" if measure else ""), profile=profile)


def copy_allowed(names: list[str], ignored: list[str]) -> list[str]:
    """The names that match none of the patterns."""
    return [x for x in names if not any(fnmatch(x, p) for p in ignored)]


#: Never copied out of a corpus.
PRIVATE = ("cookies*", "*.key", "*.tmp", "_temporary*", ".*")


def copy_corpus(spark: SparkSession, source: str, target: str, *, patterns: tuple[str, ...] = ("*",), ignored: tuple[str, ...] = PRIVATE) -> list[str]:
    """Copies the files below one shared folder whose path or name matches a pattern to another; returns their paths.

    Both may be on any file system that Hadoop knows. Each file is copied under a name of its own that
    is renamed when it is whole, so a reader of the target never sees a part of one. A target's other files stay.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(source)
    system = root.getFileSystem(conf)
    if not system.exists(root):
        raise FileNotFoundError(source)
    base, names, files = system.makeQualified(root).toString().rstrip("/"), [], system.listFiles(root, True)
    while files.hasNext():
        names.append(files.next().getPath().toString()[len(base) + 1 :])
    allowed = {x for x in copy_allowed(names, list(ignored)) if not any(fnmatch(part, p) for part in x.split("/") for p in ignored)}
    chosen = sorted(x for x in allowed if any(fnmatch(x, p) or fnmatch(x.rsplit("/", 1)[-1], p) for p in patterns))
    to = jvm.org.apache.hadoop.fs.Path(target).getFileSystem(conf)
    for name in chosen:
        whole, part = (jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}/{name}{x}") for x in ("", ".part"))
        jvm.org.apache.hadoop.fs.FileUtil.copy(system, jvm.org.apache.hadoop.fs.Path(f"{base}/{name}"), to, part, False, True, conf)
        to.delete(whole, False)
        to.rename(part, whole)
    return chosen


def fetch_options(cookies_file: str | None = None, **more: object) -> dict[str, object]:
    """Options of a fetcher: quiet, no playlists, cookies only where a file is named; what is given wins."""
    own: dict[str, object] = {"quiet": True, "noplaylist": True} | ({"cookiefile": cookies_file} if cookies_file else {})
    return own | more


def run_command(command: list[str]) -> str:
    """What a program writes; RuntimeError with the end of its messages where it fails."""
    done = subprocess.run(command, capture_output=True, text=True, check=False)
    if done.returncode:
        raise RuntimeError(f"{command[0]} ended with {done.returncode}: {done.stderr[-2000:]}")
    return done.stdout


def ingest(spark: SparkSession, urls: list[str], log: StageLog, config_hash: str, fetch: Callable[[str], dict], path: str) -> DataFrame:
    """Runs `fetch` for the URLs that aren't done: url, status, error, rows_out of what this run did.

    fetch gives a JSON-like dictionary for a URL, or raises; one URL that fails is logged and the others go on. Each
    result is a row (video_id: the URL, info: JSON) at `path`. A URL that was ingested with these settings is skipped.
    """

    def work(todo: DataFrame) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for url in batch.column(0).to_pylist():
                    try:
                        rows.append((url, json.dumps(fetch(url), sort_keys=True), None))
                    except Exception as e:  # one bad item mustn't end the run
                        rows.append((url, None, f"{type(e).__name__}: {e}"[:2000]))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*rows, strict=True)], names=["video_id", "info", "error"])

        return todo.mapInArrow(each, "video_id string, info string, error string")

    listed = spark.createDataFrame([(x,) for x in dict.fromkeys(urls)], "video_id string")
    return log.run(listed, "ingest", config_hash, work, path).withColumnRenamed("video_id", "url")


class Layout:
    """Where a corpus keeps its parts."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def table(self, name: str) -> str:
        return f"{self.root}/db/{name}"

    def derived(self, video_id: str) -> str:
        return f"{self.root}/derived/{video_id}"

    def audio(self, video_id: str) -> str:
        return f"{self.derived(video_id)}/audio.wav"

    @property
    def index(self) -> str:
        return f"{self.root}/index"
