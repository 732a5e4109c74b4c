"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are hashed n-grams of one to three lower-cased characters; a term's frequency is its share of the text's
n-grams. Document frequencies come from every training row. Weights are trained on a bounded sample with
follow-the-regularised-leader (per-coordinate rates, L1 and L2 penalties), and a temperature fitted on rows of the
sample kept out of training turns scores into probabilities.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, id_crc, map_arrow, slices, sum_vectors, texts

BITS = 15
SIZE = 1 << BITS
#: Rows of each language, about, that the weights are fitted on, by a hash of the id; rows of all languages together.
SAMPLE_EACH, SAMPLE_ALL = 1200, 240_000
HASHES = 1 << 40
#: FTRL: rate, its smoothing, L1, L2, passes over the sample. SCALE multiplies shares of n-grams.
ALPHA, BETA, L1, L2, EPOCHS, SCALE = 0.5, 1.0, 0.2, 0.1, 3, 30.0
UNKNOWN = "und"


def ngram_counts(data: list[bytes | None]):
    """For each text the counts of its hashed n-grams."""
    lowered = [(x or b"").decode("utf-8", "replace").lower().replace("\0", " ") for x in data]
    points = np.frombuffer(("\0".join(lowered) + "\0\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)
    a, b, c = points[:-2], points[1:-1], points[2:]
    one = a * np.uint32(0x9E3779B1)
    two = one ^ (b * np.uint32(0x85EBCA77))
    three = two * np.uint32(31) ^ (c * np.uint32(0xC2B2AE3D))
    shift = np.uint32(32 - BITS)
    hashed = [(x * np.uint32(0x27D4EB2F)) >> shift for x in (one + np.uint32(1), two + np.uint32(7), three + np.uint32(13))]
    first = 0
    for text in lowered:
        n = len(text)
        own = [h[first : first + max(n - k, 0)] for k, h in enumerate(hashed)]
        yield np.bincount(np.concatenate(own), minlength=SIZE)
        first += n + 1


def _frequencies(batches):
    total = np.zeros(SIZE + 1, np.int64)  # the last counts the rows
    for _, data, _ in slices(batches, 1_000_000):
        for counts in ngram_counts(data):
            total[:SIZE] += counts > 0
            total[SIZE] += 1
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["vector"])


def _sparse(batches):
    for _, data, rows in slices(batches, 1_000_000):
        out = []
        for counts in ngram_counts(data):
            at = np.flatnonzero(counts)
            out.append((at.astype("<u4").tobytes(), counts[at].astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([rows.column(rows.schema.get_field_index("lang")), rows.column(0), *(pa.array(x, pa.binary()) for x in zip(*out, strict=True))], names=["lang", "doc_id", "at", "counts"])


class Ftrl:
    """Multinomial logistic regression, one row at a time; row SIZE is the bias."""

    def __init__(self, classes: int):
        self.z = np.zeros((SIZE + 1, classes))
        self.n = np.zeros((SIZE + 1, classes))

    def weights(self, at) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        g = softmax(x @ w)
        g[y] -= 1
        g = x[:, None] * g[None, :]
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """That of the least negative log-likelihood, by golden section over its logarithm."""
    if not len(y):
        return 1.0

    def loss(log_t: float) -> float:
        return -np.log(softmax(logits / np.exp(log_t))[np.arange(len(y)), y] + 1e-12).mean()

    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


class Model:
    def __init__(self, languages: list[str], table: np.ndarray, bias: np.ndarray, t: float):
        self.languages, self.table, self.bias, self.t = languages, table, bias, t

    def logits(self, counts: np.ndarray) -> np.ndarray:
        return (SCALE / max(counts.sum(), 1)) * (counts @ self.table) + self.bias


def fit(rows: list, frequencies: np.ndarray) -> Model | None:
    """rows: lang, doc_id, at, counts of the sample."""
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    idf = np.log((1 + frequencies[SIZE]) / (1 + frequencies[:SIZE])) + 1
    examples = []
    for r in rows:
        at, counts = np.frombuffer(bytes(r["at"]), "<u4").astype(np.int64), np.frombuffer(bytes(r["counts"]), "<u4")
        examples.append((np.append(at, SIZE), np.append(counts * (SCALE / max(counts.sum(), 1)) * idf[at], 1.0), languages.index(r["lang"])))
    kept_out = [zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2 for r in rows]
    model = Ftrl(len(languages))
    order = np.random.default_rng(7).permutation(len(examples))
    for _ in range(EPOCHS):
        for k in order:
            if not kept_out[k]:
                model.learn(*examples[k])
    w = model.weights(slice(None))
    held = [e for e, out in zip(examples, kept_out, strict=True) if out]
    logits = np.array([x @ w[at] for at, x, _ in held]).reshape(-1, len(languages))
    t = temperature(logits, np.array([y for *_, y in held], int))
    return Model(languages, (idf[:, None] * w[:SIZE]).astype(np.float32), w[SIZE], t)


def _predicted(model):
    def run(batches):
        own = model.value
        for ids, data, rows in slices(batches, 1_000_000):
            found = []
            for raw, counts in zip(data, ngram_counts(data), strict=True):
                if own is None or not raw or not any(map(str.isalpha, raw.decode("utf-8", "replace"))):
                    found.append((UNKNOWN, 0.0))
                    continue
                p = softmax(own.logits(counts) / own.t)
                best = int(np.argmax(p))
                found.append((own.languages[best], float(p[best])))
            names, scores = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), rows.column(rows.schema.get_field_index("held_out")), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def sampled(learning: DataFrame, each: int, most: int, scratch: Scratch) -> DataFrame:
    """doc_id, text, lang of about `each` rows of a language, fewer where all languages would pass `most`, at least one.

    Each row is judged by its own hash against its language's limit, so no language meets in one task.
    """
    rows = learning.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("hash", F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)))
    languages = scratch.table(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("least")), "languages")
    each = max(1, min(each, most // max(1, languages.count())))
    share = (F.lit(float(HASHES * each)) / F.col("n")).cast("long")
    limits = languages.select("lang", F.greatest("least", share).alias("limit"))  # one row of a language; Spark broadcasts it by its written size
    return rows.join(limits, "lang").where(F.col("hash") <= F.col("limit")).select("doc_id", "text", "lang")


def identify(docs: DataFrame, *, held_out: Column | None = None, sample_each: int = SAMPLE_EACH, sample_all: int = SAMPLE_ALL) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score.

    Learns from rows with a language and an id that are not held out. lang_pred is `und` with score 0 where the text is
    null or has no letter, and everywhere if there is nothing to learn from. sample_each bounds the rows of a language
    that weights are fitted on, about, and sample_all those of all languages, but for one row of each; document frequencies
    come from all. Rows that repeat an id count each and are sampled together; of equal scores the first language by name is
    taken; a text of any length is one vector of n-gram counts. Every language is learnt: the fit's time grows with their
    number. A row of the sample has 32,768 n-grams at most, of 8 bytes each, and the driver holds it twice: a text of some
    thousand words takes about 30 KB, so a sample of 240,000 long texts takes up to 8 GB, and sample_all must be lowered
    where the driver has less. An empty table gives no rows; columns other than doc_id, text and lang are left behind.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "language")
    out = F.coalesce(id_crc() % 3 == 1, F.lit(False)) if held_out is None else held_out
    learning = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~out)
    frequencies = sum_vectors(map_arrow(texts(learning), _frequencies, "vector binary"), SIZE + 1, scratch, "frequencies")
    rows = sampled(learning, sample_each, sample_all, scratch)
    sample = map_arrow(rows, _sparse, "lang string, doc_id long, at binary, counts binary").collect()
    model = spark.sparkContext.broadcast(fit(sample, frequencies))
    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), out.alias("held_out"))
    return map_arrow(asked, _predicted(model), "doc_id long, held_out boolean, lang_pred string, score double")
