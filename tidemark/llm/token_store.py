"""Token ids in a content-addressed store.

    chunks/     digest, ids (unsigned 16-bit where every id fits, else 32-bit); each distinct chunk once
    recipes/    part, doc_id, start, n_tokens, digests, lengths; ascending doc_id, part by part
    manifest/   part, level, node, digest: a Merkle tree over the recipes of each part, and over the parts to one root

A gear hash over the last 32 ids cuts a document's ids wherever its low bits are zero, so equal passages give equal
chunks wherever they stand. Reading back hashes every stored chunk anew, compares the trees, and gets a document's
checksum by joining its chunks' checksums, so contents are never shuffled again.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tidemark.llm.common import Scratch, map_arrow, partitions_for, slices, texts
from tidemark.llm.tokens import CACHE, default_path, document_ids

#: Ids in a chunk: at least, at most, and the bits of the gear hash that are zero at a cut (about 2,300 ids on average).
LEAST, MOST, CUT_BITS = 256, 16_384, 11
FAN = 256
CHUNK, RECIPE = 0, 1
#: Digests that a task remembers, so that it sends a chunk once; bytes of text whose chunks one partition keeps once.
_SEEN, _PART_BYTES = 300_000, 128_000_000
RECIPES = "part int, doc_id long, start long, n_tokens long, digests binary, lengths binary"


def _gear() -> np.ndarray:
    x = np.arange(1 << 16, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return (x ^ (x >> np.uint64(31))).astype(np.uint32)


_GEAR = _gear()


def cut_marks(ids: np.ndarray) -> np.ndarray:
    """Ends where a chunk may end, over the ids of many documents: the 32 ids that decide lie within LEAST."""
    h = _GEAR[ids & 0xFFFF]
    for width in (1, 2, 4, 8, 16):  # after these steps each value covers 32 ids
        h[width:] += h[:-width] << np.uint32(width)
    return np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1


def cuts(marks: list[int], n: int) -> list[int]:
    """Ends of the chunks of a document of n ids with these marks."""
    found, last = [], 0
    for at in [*marks, n]:
        while at - last > MOST:
            last += MOST
            found.append(last)
        if at - last >= LEAST or at == n:
            found.append(at)
            last = at
    return found if found[-1] == n else [*found, n]


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4")


def _chunked(path: str):
    blake2b = hashlib.blake2b

    def run(batches):
        from pyspark import TaskContext

        row, task, own = 0, TaskContext.get().partitionId(), set()
        for ids, data, _ in slices(batches, keep=CACHE):
            if len(own) > _SEEN:
                own = set()
            out = []
            tokens, ends = document_ids(data, path)
            ends = ends.tolist()
            marks = cut_marks(tokens)
            bounds = np.searchsorted(marks, [0, *ends], side="right").tolist()
            marks = marks.tolist()
            width = 2 if tokens.max() < 1 << 16 else 4
            packed = tokens.astype(f"<u{width}").tobytes()
            begin, first_byte = 0, bytes([width])  # of a chunk: the width of an id
            for doc_id, end, a, b in zip(ids, ends, bounds[:-1], bounds[1:], strict=True):
                first, digests, lengths = begin, [], []
                for at in cuts([x - begin for x in marks[a:b]], end - begin):
                    at += begin
                    content = first_byte + packed[width * first : width * at]
                    digests.append(digest := blake2b(content, digest_size=16).digest())
                    lengths.append(at - first)
                    if digest not in own:
                        own.add(digest)
                        out.append((CHUNK, digest, None, None, content, None))
                    first = at
                row += 1
                out.append((RECIPE, b"%d.%d" % (task, row), doc_id, end - begin, b"".join(digests), np.array(lengths, "<u4").tobytes()))
                begin = end
            types = (pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["kind", "key", "doc_id", "n_tokens", "data", "lengths"])

    return run


def _once(batches):
    """Rows of a partition by key, each key once: equal chunks come from each task about once."""
    seen: set[bytes] = set()
    for batch in batches:
        fresh = []
        for at, key in enumerate(batch.column(1).to_pylist()):
            if key not in seen:
                seen.add(key)
                fresh.append(at)
        yield batch.take(pa.array(fresh, pa.int64())) if len(fresh) < len(batch) else batch


def write_store(docs: DataFrame, path: str, *, tokenizer: str | None = None) -> None:
    """Writes the store. A null text is an empty one and holds the end id only; null doc_ids come first, ties by content."""
    spark = docs.sparkSession
    rows = map_arrow(texts(docs), _chunked(tokenizer or default_path()), "kind int, key binary, doc_id long, n_tokens long, data binary, lengths binary")
    size = texts(docs).agg(F.sum(F.octet_length("text"))).first()[0] or 0
    unique = map_arrow(rows.repartition(partitions_for(spark, size, _PART_BYTES), "key"), _once, ", ".join(f"{name} {kind}" for name, kind in rows.dtypes))
    unique.write.partitionBy("kind").option("compression", "zstd").parquet(f"{path}/staged")
    staged = spark.read.schema("key binary, doc_id long, n_tokens long, data binary, lengths binary, kind int").parquet(f"{path}/staged")
    recipes = staged.where(F.col("kind") == RECIPE).select("doc_id", "n_tokens", F.col("data").alias("digests"), "lengths")
    parts = partitions_for(spark, recipes.count(), 50_000)
    ranged = recipes.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "digests").withColumn("part", F.spark_partition_id())
    ranged.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "digests").write.option("compression", "zstd").parquet(f"{path}/ranged")
    ranged = spark.read.schema("doc_id long, n_tokens long, digests binary, lengths binary, part int").parquet(f"{path}/ranged")
    before = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").asc_nulls_first(), "digests")
    started = ranged.withColumn("inside", F.sum("n_tokens").over(inside.rowsBetween(Window.unboundedPreceding, -1))).join(
        F.broadcast(before), "part"  # a row for each part
    )
    started.select("part", "doc_id", (F.col("before") + F.coalesce("inside", F.lit(0))).alias("start"), "n_tokens", "digests", "lengths").write.option("compression", "zstd").parquet(f"{path}/recipes")
    tree(read_recipes(spark, path)).write.parquet(f"{path}/manifest")


def read_recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPES).parquet(f"{path}/recipes")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key binary, data binary, kind int").parquet(f"{path}/staged").where(F.col("kind") == CHUNK).select(F.col("key").alias("digest"), "data")


def tree(recipes: DataFrame) -> DataFrame:
    """Merkle tree: level 0 has a node for each FAN documents of a part, level 1 one for each FAN of those, level 2 one for
    each part, level 3 one for each FAN parts, level 4 the root. Nodes over parts have part 0."""
    leaf = F.sha2(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(":").cast("binary"), F.col("digests"), F.col("lengths")), 256)
    rows = recipes.select("part", (F.row_number().over(Window.partitionBy("part").orderBy("start")) - 1).alias("at"), leaf.alias("digest"))
    levels = []
    for level in range(5):
        node = F.floor(F.col("at") / FAN) if level in (0, 1, 3) else F.lit(0).cast("long")
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), "")
        rows = rows.groupBy("part", node.alias("node")).agg(F.sha2(joined.cast("binary"), 256).alias("digest"))
        levels.append(rows.select("part", F.lit(level).alias("level"), "node", "digest"))
        rows = rows.select("part", F.col("node").alias("at"), "digest")
        if level == 2:
            rows = rows.select(F.lit(0).alias("part"), F.col("part").cast("long").alias("at"), "digest")
    return reduce(DataFrame.unionByName, levels)


def root(spark: SparkSession, path: str) -> str | None:
    """The digest of the whole store as its manifest has it; None for an empty one."""
    found = _manifest(spark, path).where(F.col("level") == 4).first()
    return found["digest"] if found else None


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("part int, level int, node long, digest string").parquet(f"{path}/manifest")


def verify_manifest(spark: SparkSession, path: str) -> None:
    """Raises if a node of the trees over the stored recipes isn't the one in the manifest."""
    at = ["part", "level", "node"]
    wrong = _manifest(spark, path).join(tree(read_recipes(spark, path)).withColumnRenamed("digest", "now"), at, "full").where(~F.col("digest").eqNullSafe(F.col("now")))
    if found := wrong.select(*at).take(3):
        raise ValueError(f"the recipes in {path} don't match the manifest: {found}")


def _crc_steps() -> list[np.ndarray]:
    """Operators on a crc32 for 1, 2, 4, ... zero bytes that follow; each has the images of its 32 bits."""

    def apply(matrix: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), np.uint32)
        for bit in range(32):
            out ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
        return out

    zero_bit = np.array([0xEDB88320, *(1 << n for n in range(31))], np.uint32)
    square = zero_bit
    for _ in range(3):
        square = apply(square, square)
    steps = [square]
    for _ in range(40):
        steps.append(apply(steps[-1], steps[-1]))
    return steps


_CRC_STEPS = _crc_steps()


def crc_moved(crc: np.ndarray, after: np.ndarray) -> np.ndarray:
    """What a crc32 adds to that of its bytes and `after` bytes more: the xor of these is the crc32 of the whole."""
    out = crc.astype(np.uint32)
    for k, matrix in enumerate(_CRC_STEPS):
        if not (after >> k).any():
            break
        at = np.flatnonzero(after >> k & 1)
        values, moved = out[at], np.zeros(len(at), np.uint32)
        for bit in range(32):
            moved ^= np.where(values >> np.uint32(bit) & np.uint32(1), matrix[bit], np.uint32(0))
        out[at] = moved
    return out


def _checked(batches):
    blake2b, crc32 = hashlib.blake2b, zlib.crc32
    for batch in batches:
        digests, data = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for digest, content in zip(digests, data, strict=True):
            if blake2b(content, digest_size=16).digest() != digest:
                raise ValueError(f"the chunk {digest.hex()} doesn't have that digest")
        widths = {x[0] for x in data}
        if widths == {2}:  # all at once
            ids = memoryview(np.frombuffer(b"".join([x[1:] for x in data]), "<u2").astype("<u4").tobytes())
            lengths = [len(x) // 2 for x in data]
            ends = (np.cumsum(lengths) * 4).tolist()
            crcs = [crc32(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        else:
            lengths, crcs = [len(x) // x[0] for x in data], [crc32(unpacked(x).tobytes()) for x in data]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())], names=["digest", "length", "crc"])


def _references(batches):
    for batch in batches:
        starts, digests, lengths = (batch.column(k).to_pylist() for k in range(3))
        out = []
        for start, names, sizes in zip(starts, digests, lengths, strict=True):
            size = np.frombuffer(sizes, "<u4").astype(np.int64)
            after = (size.sum() - np.cumsum(size)) * 4
            out += [(start, names[16 * k : 16 * k + 16], n, m) for k, (n, m) in enumerate(zip(size.tolist(), after.tolist(), strict=True))]
        types = (pa.int64(), pa.binary(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["start", "digest", "expected", "after"])


@F.pandas_udf(LongType())
def _moved(crc: pd.Series, after: pd.Series) -> pd.Series:
    return pd.Series(crc_moved(crc.to_numpy(), after.to_numpy()).astype(np.int64))


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files; every chunk and recipe is verified."""
    verify_manifest(spark, path)
    recipes = read_recipes(spark, path)
    chunks = map_arrow(read_chunks(spark, path), _checked, "digest binary, length long, crc long")
    references = map_arrow(recipes.select("start", "digests", "lengths"), _references, "start long, digest binary, expected long, after long")
    found = references.join(chunks, "digest", "left")
    fits = F.when(F.col("length") == F.col("expected"), F.col("length"))
    found = found.select("start", F.coalesce(fits, F.raise_error(F.lit("a chunk is missing or of another length")).cast("long")).alias("length"), _moved("crc", "after").alias("crc"))
    whole = found.groupBy("start").agg(F.sum("length").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"))
    return recipes.select("doc_id", "start").join(whole, "start").select("doc_id", "start", "n_tokens", "ids_crc32")


def _joined(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([b"".join(unpacked(x).tobytes() for x in pieces) for pieces in batch.column(2).to_pylist()], pa.binary())], names=["doc_id", "start", "ids"])


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids (little-endian unsigned 32-bit) of each document, rebuilt from its chunks."""
    references = map_arrow(read_recipes(spark, path).select("start", "digests", "lengths"), _references, "start long, digest binary, expected long, after long")
    pieces = references.join(read_chunks(spark, path), "digest").groupBy("start").agg(F.array_sort(F.collect_list(F.struct((-F.col("after")).alias("at"), "data"))).alias("pieces"))
    rows = read_recipes(spark, path).select("doc_id", "start").join(pieces, "start").select("doc_id", "start", F.col("pieces.data").alias("pieces"))
    return map_arrow(rows, _joined, "doc_id long, start long, ids binary")


def token_store(docs: DataFrame, *, path: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Writes the store at `path`, a folder of the shared one unless given, and returns what read_store() finds in it.

    One row per row of docs: doc_id, start, n_tokens, ids_crc32. A null or empty text is its end id. Rows that repeat a
    doc_id each have their place, in the order of their content; null ids come first. A text of any length is encoded
    whole and stored in chunks of bounded size. An empty table is an empty store; other columns are left behind.
    """
    path = path or Scratch(docs.sparkSession, "token_store").path
    write_store(docs, path, tokenizer=tokenizer)
    return read_store(docs.sparkSession, path)
