"""Centroid clustering of integer vectors, exact at any size.

Vectors are written once as blocks of integers in the narrowest type that holds them. A round reads the blocks, assigns
their vectors by |x|^2 - 2 x.c + |c|^2 with the products as matrix products in float64, and combines counts and sums by
treeAggregate, so that a round sends the driver some numbers for each centroid. Every sum in such a product is an integer
below 2^53 if all components are below a bound, so no addition rounds, in whatever order the library adds. Pairs of a
vector and a centroid beyond it are computed in 64-bit integers up to another bound, and in whole numbers of any size above.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, drop_caches, map_arrow

#: Components are below bounds so small that D times the square of twice them is no more than 2^53, or 2^63; see bounds().
FLOAT_BITS, LONG_BITS = 53, 63
#: Vectors in a block at most.
BLOCK = 4096
LONG = (1 << 63) - 1
BLOCKS = "kind string, n int, ids binary, id_nulls binary, vectors binary"


def bounds(dims: int) -> tuple[int, int]:
    """The greatest powers of two below which float64 and 64-bit integers hold every sum of a distance."""
    bits = (dims - 1).bit_length()
    return 1 << (FLOAT_BITS - bits) // 2 - 1, 1 << (LONG_BITS - bits) // 2 - 1


def _scaled(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """floor(scale * x): which rows fit 64-bit integers with room, those, and the others as whole numbers. scale is a
    power of two, so the product is exact."""
    fits = np.abs(x).max(axis=1) < 2.0**61 / scale
    wide = [[int(v) * scale if abs(v) >= 2.0**53 else int(np.floor(v * scale)) for v in row] for row in x[~fits].tolist()]
    return fits, np.floor(x[fits] * scale).astype(np.int64), wide


def _packed(x: np.ndarray) -> tuple[str, bytes]:
    most = int(np.abs(x).max()) if x.size else 0
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    return kind, x.astype(kind).tobytes()


def unpacked(kind: str, data: bytes, dims: int) -> np.ndarray:
    if kind == "wide":
        return np.array([int(v) for v in data.split(b",")], object).reshape(-1, dims)
    return np.frombuffer(data, kind).astype(np.int64).reshape(-1, dims)


def usable(embedding: Column, dims: int) -> Column:
    """Exactly dims components, none null, infinite or not a number."""
    good = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce((F.size(embedding) == dims) & good, F.lit(False))


def blocks_of(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """Rows of BLOCKS of vectors (vec_id, embedding), all usable."""

    def run(batches):
        drop_caches()
        for batch in batches:
            for first in range(0, batch.num_rows, BLOCK):
                part = batch.slice(first, BLOCK)
                x = np.asarray(part.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dims)
                ids = part.column(0)
                nulls, ids = np.asarray(ids.is_null()), np.asarray(ids.fill_null(0))
                fits, narrow, wide = _scaled(x, scale)
                rows = [(*_packed(narrow), fits)] if len(narrow) else []
                rows += [("wide", b",".join(str(v).encode() for row in wide for v in row), ~fits)] if wide else []
                out = [(kind, int(which.sum()), ids[which].astype("<i8").tobytes(), nulls[which].tobytes(), data) for kind, data, which in rows]
                types = (pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["kind", "n", "ids", "id_nulls", "vectors"])

    return map_arrow(vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")), run, BLOCKS)


def _distances(x: np.ndarray, centroids: list[list[int]], level: int, small: int, middle: int) -> np.ndarray:
    """Squared distances of vectors of one magnitude (0: small, 1: middle, 2: any) from all centroids."""
    levels = [max(level, 0 if (most := max(map(abs, c))) < small else 1 if most < middle else 2) for c in centroids]
    out = np.empty((len(x), len(centroids)), object if max(levels) == 2 else np.int64)
    if own := [k for k, at in enumerate(levels) if at == 0]:
        a, b = x.astype(np.float64), np.array([centroids[k] for k in own], np.float64)
        near = np.einsum("ij,ij->i", a, a)[:, None] - 2 * (a @ b.T) + np.einsum("ij,ij->i", b, b)
        out[:, own] = near.astype(np.int64)
    for k in (k for k, at in enumerate(levels) if at):
        kind = np.int64 if levels[k] == 1 else object
        away = x.astype(kind) - np.array(centroids[k], kind)
        out[:, k] = (away * away).sum(axis=1)
    return out


def assign(x: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int]]:
    """Of each vector the nearest centroid, of equally near ones the first, and its squared distance."""
    small, middle = bounds(x.shape[1])
    most = np.abs(x).max(axis=1)
    level = np.where(most < small, 0, np.where(most < middle, 1, 2))
    labels, away = np.zeros(len(x), np.int64), np.zeros(len(x), object)
    for at in np.unique(level).tolist():
        rows = np.flatnonzero(level == at)
        found = _distances(x[rows], centroids, at, small, middle)
        labels[rows] = nearest = np.argmin(found, axis=1)
        away[rows] = found[np.arange(len(rows)), nearest]
    return labels, away.tolist()


def summed(x: np.ndarray, labels: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How many vectors each centroid has, and the sums of their components as whole numbers."""
    small, middle = bounds(x.shape[1])
    most, counts = max(abs(int(x.min())), abs(int(x.max()))), np.bincount(labels, minlength=k)
    if most < small:
        chosen = np.zeros((k, len(x)))
        chosen[labels, np.arange(len(x))] = 1
        sums = (chosen @ x.astype(np.float64)).astype(np.int64).astype(object)
    else:
        kind = np.int64 if most < middle else object
        sums = np.array([x[labels == c].astype(kind).sum(axis=0) if counts[c] else [0] * x.shape[1] for c in range(k)], object)
    return counts.astype(object), sums


def _added(a, b):
    if a is None or b is None:
        return b if a is None else a
    return tuple(x + y for x, y in zip(a, b, strict=True))


@dataclass(frozen=True)
class Clusters:
    """Final centroids, how many vectors each has, and the sum of their squared distances."""

    centroids: list[list[int]]
    counts: list[int]
    inertia: list[int]

    def sha256(self) -> list[str]:
        return [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in self.centroids]


def starting(vectors: DataFrame, k: int, salt: int, dims: int, scale: int) -> list[list[int]]:
    """The k vectors with the smallest sha256 of `salt:vec_id`, in that order; of equal ids the smaller vector is first.

    Vectors are looked at whose hash is below a bound that some hundred pass, raised until k are found, so no task or
    driver holds k vectors of every partition.
    """
    hashed = vectors.where("vec_id IS NOT NULL").withColumn("_hash", F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256))
    total = hashed.count()
    part = min(1.0, 16.0 * k / max(total, 1))
    while True:
        below = hashed if part >= 1 else hashed.where(F.conv(F.substring("_hash", 1, 12), 16, 10).cast("long") < int(part * (1 << 48)))
        rows = below.select("_hash", F.col("embedding").cast("array<double>").alias("embedding")).orderBy("_hash", "embedding").limit(k).collect()
        if len(rows) == k or part >= 1:
            break
        part = min(1.0, 8 * part)
    out = []
    for r in rows:
        _, narrow, wide = _scaled(np.array([r["embedding"]], np.float64), scale)
        out.append(wide[0] if wide else narrow[0].tolist())
    return out


def fit(blocks: DataFrame, centroids: list[list[int]], rounds: int, dims: int) -> Clusters:
    """Rounds of assigning every vector and moving each centroid that has any to floor(sum / count). A round that moves
    none is the last one, as those after it would find the same."""
    rows = blocks.select("kind", "vectors").rdd

    def moved(now: list[list[int]]):
        def add(total, row):
            x = unpacked(row[0], bytes(row[1]), dims)
            return _added(total, summed(x, assign(x, now)[0], len(now)))

        return rows.treeAggregate(None, add, _added)

    def measured(now: list[list[int]]):
        def add(total, row):
            x = unpacked(row[0], bytes(row[1]), dims)
            labels, away = assign(x, now)
            inertia = np.zeros(len(now), object)
            for label, d in zip(labels.tolist(), away, strict=True):
                inertia[label] += d
            return _added(total, (np.bincount(labels, minlength=len(now)).astype(object), inertia))

        return rows.treeAggregate(None, add, _added)

    for _ in range(rounds if centroids else 0):
        counts, sums = moved(centroids)
        new = [[int(s) // int(n) for s in total] if n else c for c, n, total in zip(centroids, counts.tolist(), sums.tolist(), strict=True)]
        if new == centroids:
            break
        centroids = new
    if not centroids:
        return Clusters([], [], [])
    counts, inertia = measured(centroids)
    return Clusters(centroids, [int(n) for n in counts], [int(x) for x in inertia])


def cluster_vectors(vectors: DataFrame, *, k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: int = 3) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector (vec_id, embedding) that has
    exactly dims components, none null or not finite; the others, null embeddings among them, have no row.

    A component x counts as floor(scale * x), scale a power of two. The k vectors with the smallest sha256 of
    `salt:vec_id` start; fewer if there are fewer with an id, and without any there are no rows. Rows that repeat count
    as often as they come; a null vec_id takes part but starts no centroid. Distances and inertia that a long can't hold
    are null. Other columns are left behind. An executor holds a batch of vectors and its blocks; the driver k centroids.
    """
    if scale < 1 or scale & (scale - 1):
        raise ValueError("the scale must be a power of two")
    spark = vectors.sparkSession
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(usable(F.col("embedding"), dims))
    scratch = Scratch(spark, "centroids")
    blocks = scratch.table(blocks_of(own, dims, scale), "blocks")
    found = fit(blocks, starting(own, k, salt, dims, scale), rounds, dims)
    centroids, digests = found.centroids, found.sha256()
    fitting = [x if x <= LONG else None for x in found.inertia]
    total = sum(found.inertia) if sum(found.inertia) <= LONG else None

    def run(batches):
        for batch in batches:
            for kind, n, ids, nulls, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                labels, away = assign(unpacked(kind, data, dims), centroids)
                chosen = labels.tolist()
                columns = [
                    pa.array(np.frombuffer(ids, "<i8"), pa.int64(), mask=np.frombuffer(nulls, bool)), pa.array(labels.astype(np.int32)), pa.array([d if d <= LONG else None for d in away], pa.int64()),
                    pa.array([fitting[c] for c in chosen], pa.int64()), pa.array([total] * n, pa.int64()), pa.array([digests[c] for c in chosen], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    return map_arrow(blocks, run, schema) if centroids else spark.createDataFrame([], schema)


def sql(k: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: int = 3) -> str:
    """DuckDB SQL for the rows of cluster_vectors() over `embeddings`; its rounds are one query after the other."""
    asked = f"len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims}"
    parts = [
        f"v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS x FROM embeddings WHERE {asked})",
        f"c0 AS MATERIALIZED (SELECT CAST(row_number() OVER (ORDER BY h, x) AS INTEGER) - 1 AS k, x AS c FROM (SELECT sha256('{salt}:' || vec_id) AS h, x FROM v WHERE vec_id IS NOT NULL ORDER BY h, x LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        away = "list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        parts.append(f"a{n} AS MATERIALIZED (SELECT r, min(struct_pack(d, k)) AS best FROM (SELECT r, k, CAST({away} AS BIGINT) AS d FROM v, c{n}) GROUP BY r)")
        if n < rounds:
            parts.append(f"s{n} AS (SELECT best.k AS k, j, sum(x[j]) AS s, count(*) AS n FROM a{n} JOIN v USING (r), unnest(range(1, {dims + 1})) AS u(j) GROUP BY ALL)")
            parts.append(f"m{n} AS (SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS c FROM s{n} GROUP BY k)")
            parts.append(f"c{n + 1} AS MATERIALIZED (SELECT c{n}.k AS k, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} ON c{n}.k = m{n}.k)")
    return f"""
        WITH {', '.join(parts)}
        SELECT vec_id, best.k AS cluster, best.d AS distance, CAST(sum(best.d) OVER (PARTITION BY best.k) AS BIGINT) AS cluster_inertia,
               CAST(sum(best.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (r) JOIN c{rounds} AS f ON f.k = best.k
    """
