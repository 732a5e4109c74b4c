"""Exact dedup: rows grouped by a 128-bit hash of the normalised text, bytes compared inside groups.

Hashing is one pass over the texts. Only rows whose hash falls in a bucket of a hash that repeats send their text
through a shuffle, where the least and the greatest text of a hash show whether its bytes differ; both are found by
map-side partial aggregation, so a group of copies of any size meets as one row from each task. Hashes whose bytes
differ (collisions) are grouped again by hash and bytes.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, Scratch, by_row, drop_caches, further_rows, map_arrow, own_columns, texts, with_rows

#: Buckets of repeated hashes that are broadcast: never more rows than this, whatever the corpus holds.
BUCKETS = 1 << 18


def _hashed(keep_text: bool, digest_bytes: int):
    def run(batches):
        drop_caches()
        for batch in batches:
            data = [(x or b"").lower() for x in batch.column(1).to_pylist()]  # bytes.lower() changes A-Z only
            digests = [hashlib.md5(x, usedforsecurity=False).digest()[:digest_bytes] for x in data]
            columns = [batch.column(0), pa.array(digests, pa.binary()), pa.array([int.from_bytes(x[:4], "little") % BUCKETS for x in digests], pa.int32())]
            names = ["doc_id", "hash", "bucket"]
            if keep_text:
                columns.append(pa.array(data, pa.binary()))
                names.append("norm")
            else:
                columns.append(pa.array([hashlib.sha256(x).digest() for x in data], pa.binary()))
                names.append("sha")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def exact_dedup(docs: DataFrame, *, keep: str = "smallest", digest_bytes: int = 16) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    keep: `smallest` or `largest` doc_id of equal texts stays. A null text is an empty one; empty texts are equal.
    Rows that repeat a doc_id are rows of their own in group_size; the id that stays is `kept` in each of them. A null
    doc_id never stays while another id of its group can; a group of null ids only has a null keep_id and kept = true.
    Texts of any length are hashed and compared whole, byte by byte within a group. An empty table gives no rows; columns
    other than doc_id and text are left behind, whatever their names. digest_bytes below 16 is for tests of collisions.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep must be smallest or largest, not {keep!r}")
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact_dedup")
    chosen = F.min if keep == "smallest" else F.max
    hashed = scratch.table(map_arrow(texts(docs), _hashed(False, digest_bytes), "doc_id long, hash binary, bucket int, sha binary"), "hashed")
    groups = scratch.table(
        hashed.groupBy("hash").agg(F.first("bucket").alias("bucket"), F.count(F.lit(1)).alias("n"), chosen("doc_id").alias("keep_id")).where("n > 1"), "groups"
    )
    repeated = F.broadcast(groups.select("bucket").distinct())  # at most BUCKETS rows
    with_text = map_arrow(texts(docs), _hashed(True, digest_bytes), "doc_id long, hash binary, bucket int, norm binary").join(repeated, "bucket", "left_semi")
    differing = scratch.table(with_text.groupBy("hash").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a <> b").select("hash"), "differing")

    same = groups.select("hash", "n", "keep_id")
    if differing.isEmpty():
        return _result(hashed.join(same, "hash", "left"))
    apart = with_text.join(differing, "hash", "left_semi").withColumn("sha", F.unhex(F.sha2("norm", 256)))
    by_bytes = apart.groupBy("hash", "norm", "sha").agg(F.count(F.lit(1)).alias("n"), chosen("doc_id").alias("keep_id")).select("hash", "sha", "n", "keep_id")
    clean = hashed.join(differing, "hash", "left_anti").join(same, "hash", "left")
    return _result(clean.unionByName(hashed.join(differing, "hash", "left_semi").join(by_bytes, ["hash", "sha"], "left").select(*clean.columns)))


def _result(rows: DataFrame) -> DataFrame:
    alone = F.col("n").isNull()
    keep_id = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select(
        "doc_id",
        keep_id.alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep_id).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, *, keep: str = "smallest") -> DataFrame:
    """One row of each group, with all its columns: that of the smallest or largest doc_id, one with a null id only where all are null."""
    scratch = Scratch(docs.sparkSession, "kept_documents")
    rows, unique = with_rows(docs, scratch)
    found = exact_dedup(by_row(rows), keep=keep)
    if unique:
        dropped = found.where(~F.col("kept")).select(F.col("doc_id").alias(ROW))
    else:
        dropped = further_rows(found.where("group_size > 1").select(F.col("doc_id").alias(ROW), F.col("keep_id").alias("group")), rows, scratch, largest=keep == "largest")
    return rows.join(dropped, ROW, "left_anti").select(*own_columns(docs))
