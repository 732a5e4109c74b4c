"""Quality classifier: a sparse ensemble of rules.

Boosted trees over statistics of the text give paths, each a conjunction of comparisons; a logistic model with a lasso
penalty keeps few of them; what it keeps becomes Spark column expressions over the table of statistics.
"""

from __future__ import annotations

import operator
import zlib
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, Scratch, by_row, hash_sample, id_crc, map_arrow, own_columns, slices, texts, with_rows
from tidemark.llm.trees import boost

#: Labelled rows, about, that the rules are fitted on, chosen by a hash of the id.
SAMPLE = 12_000
THRESHOLD = 0.3
#: Lasso penalties that are tried on rows kept out of the fit.
PENALTIES = (0.0005, 0.002, 0.008)
_SYMBOLS = b"#$%&*|<>{}[]\\^~_=+@"

STATISTICS = (
    "n_bytes", "n_words", "mean_word", "longest_word", "upper", "digits", "symbols", "marks", "exclamations", "stops", "beyond_ascii", "distinct_words", "top_word", "repeated_next",
    "short_words", "marked_words", "lines", "mean_line", "repeated_lines", "repeated_pairs", "shouted_words", "lone_marks", "packed",
)


def _table(chosen: bytes) -> bytes:
    """Deletes all bytes but the chosen ones."""
    return bytes(set(range(256)) - set(chosen))


_DELETE = {name: _table(chosen) for name, chosen in (("upper", bytes(range(0x41, 0x5B))), ("digits", b"0123456789"), ("symbols", _SYMBOLS), ("marks", b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"), ("beyond", bytes(range(0x80, 0x100))))}
_ENDS = frozenset(b"#$%&*|!")


def statistics(raw: bytes | None) -> list[float]:
    text = raw or b""
    words = text.split()
    size, n = max(len(text), 1), max(len(words), 1)
    count = {k: len(text.translate(None, x)) for k, x in _DELETE.items()}
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    lengths = list(map(len, words))
    pairs = list(zip(words, words[1:], strict=False))
    return [
        float(len(text)), float(len(words)), sum(lengths) / n, float(max(lengths, default=0)), count["upper"] / size, count["digits"] / size, count["symbols"] / size, count["marks"] / size,
        text.count(b"!") / n, text.count(b".") / n, count["beyond"] / size, len(counts) / n, max(counts.values(), default=0) / n, sum(map(operator.eq, words, words[1:])) / n,
        sum(x <= 3 for x in lengths) / n, sum(w[-1] in _ENDS for w in words) / n, float(len(lines)), len(text) / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1),
        1 - len(set(pairs)) / max(len(pairs), 1), sum(map(bytes.isupper, words)) / n, sum(not w.isalnum() and len(w) == 1 for w in words) / n, len(zlib.compress(text, 1)) / size,
    ]


def _measured(batches):
    for ids, data, _ in slices(batches):
        columns = zip(*(statistics(x) for x in data), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(x, pa.float64()) for x in columns)], names=["doc_id", *STATISTICS])


Rule = tuple[tuple[int, bool, float], ...]


def rules_of(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """Distinct paths of boosted trees that some rows meet and some don't."""
    _, trees = boost(x, y, trees=25, depth=3, rate=0.2, least=5)
    found = dict.fromkeys(tuple(sorted(p)) for t in trees for p in t.paths())
    out, seen = [], set()
    for rule in found:
        hit = met(rule, x)
        if 0.003 * len(x) <= hit.sum() <= 0.997 * len(x) and (key := hit.tobytes()) not in seen:
            seen.add(key)
            out.append(rule)
    return out


def met(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([x[:, k] > t if above else x[:, k] <= t for k, above, t in rule])


def lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 250) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient steps."""
    n, m = a.shape
    step = 4 / max(np.linalg.norm(a, 2) ** 2 / n + 1, 1e-9)
    w, b, v, c, t = np.zeros(m), float(np.log((y.sum() + 1) / (n - y.sum() + 1))), np.zeros(m), 0.0, 1.0
    c = b
    for _ in range(steps):
        r = 1 / (1 + np.exp(-(a @ v + c))) - y
        new_w = v - step * (a.T @ r) / n
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * penalty, 0)
        new_b = c - step * r.mean()
        new_t = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, c = new_w + (t - 1) / new_t * (new_w - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    return b, w


def _loss(b: float, w: np.ndarray, a: np.ndarray, y: np.ndarray) -> float:
    s = a @ w + b
    return float((np.logaddexp(0, s) - y * s).mean())


def fit(x: np.ndarray, y: np.ndarray, kept_out: np.ndarray) -> tuple[float, list[tuple[Rule, float]]]:
    """(intercept, rules with weights)."""
    if not len(y):
        return 0.0, []
    if y.min() == y.max():
        return float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))), []
    learn = ~kept_out if len(set(y[~kept_out])) == 2 and kept_out.any() else np.ones(len(y), bool)
    rules = rules_of(x[learn], y[learn])
    a = np.array([met(r, x) for r in rules], np.float32).reshape(len(rules), len(y)).T
    fits = [lasso(a[learn], y[learn], p) for p in PENALTIES]
    test = ~learn if not learn.all() else learn
    b, w = min(fits, key=lambda f: _loss(*f, a[test], y[test]))
    return b, [(r, float(k)) for r, k in zip(rules, w, strict=True) if abs(k) > 1e-6]


def compiled(model: tuple[float, list[tuple[Rule, float]]]) -> Column:
    """The score as a column expression over the statistics."""
    b, rules = model
    terms = [F.when(reduce(operator.and_, [F.col(STATISTICS[k]) > t if above else F.col(STATISTICS[k]) <= t for k, above, t in rule]), w).otherwise(0.0) for rule, w in rules]
    return 1 / (1 + F.exp(-reduce(operator.add, terms, F.lit(b))))


def score_quality(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Learns from labelled rows whose crc32(doc_id) mod 5 is not 0; `sample` bounds how many. A null or empty text has
    statistics of zero and is scored like any other. Labels that are null, of no document or with a null id are not
    used; several labels of one id count as their majority, a tie as 1. Without labels every score is 0.5; with labels
    of one kind, the share of that kind.

    A text of any length is measured whole. Rows that repeat, or have no id, each get their row and the same score for the
    same text; equal scores are told apart by nothing, as nothing is ranked. An empty table gives no rows; columns of docs
    other than doc_id and text, and of labels other than doc_id and quality, are left behind.
    """
    return _scored(docs, labels, sample, threshold).select("doc_id", "held_out", "score", "predicted")


def _scored(docs: DataFrame, labels: DataFrame, sample: int, threshold: float, ids: DataFrame | None = None) -> DataFrame:
    """score_quality(); with ids (ROW, doc_id), docs have the name of a row as doc_id, which is ROW in the result."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    measured = scratch.table(map_arrow(texts(docs), _measured, "doc_id long, " + ", ".join(f"{c} double" for c in STATISTICS)), "statistics")
    if ids is not None:
        measured = scratch.table(measured.withColumnRenamed("doc_id", ROW).join(ids, ROW), "identified")
    marks = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("y")).where(id_crc() % 5 != 0)
    rows = hash_sample(scratch.table(measured.join(marks, "doc_id"), "labelled"), sample, "doc_id").collect()
    rows.sort(key=lambda r: (r["doc_id"], *(r[c] for c in STATISTICS)))  # the fit doesn't depend on the order of arrival
    x = np.array([[r[c] for c in STATISTICS] for r in rows]).reshape(len(rows), len(STATISTICS))
    y = np.array([r["y"] for r in rows], float)
    model = fit(x, y, np.array([zlib.crc32(f"fit{r['doc_id']}".encode()) % 6 == 0 for r in rows], bool))
    score = compiled(model)
    return measured.select(*([] if ids is None else [ROW]), "doc_id", F.coalesce(id_crc() % 5 == 0, F.lit(False)).alias("held_out"), score.alias("score")).withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def accepted(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """The rows that aren't rejected, with all their columns."""
    rows, unique = with_rows(docs, Scratch(docs.sparkSession, "accepted"))
    ids = None if unique else rows.select(ROW, F.col("doc_id").cast("long").alias("doc_id"))
    rejected = _scored(by_row(rows), labels, SAMPLE, threshold, ids).where("predicted = 0").select(F.col("doc_id" if unique else ROW).alias(ROW))
    return rows.join(rejected, ROW, "left_anti").select(*own_columns(docs))
