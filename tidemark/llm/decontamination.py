"""Benchmark decontamination by a distributed positional inverted index.

The index is sharded by document: a segment holds some documents' words as term, count and positions, so the lists of
one phrase meet within a segment and nothing is shuffled but term counts. A query intersects the lists of a window's
terms, each moved by the term's offset in the window, from the term that is rarest in the corpus to the commonest, and
stops when nothing is left. With a slop, a list entry may stand so many words from its place (proximity).

Where the benchmark is small, which is checked, segments keep only the terms that occur in it. A larger benchmark is
asked in blocks against an index of all terms.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter, defaultdict
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, Scratch, by_row, map_arrow, own_columns, slices, texts, with_rows

#: Words in a window; an item of fewer is one window.
WINDOW = 10
#: Words a term may stand from its place in a proximity match.
SLOP = 2
#: Bytes of benchmark text that one block may have; what is broadcast for it has about eight times as many.
BLOCK_BYTES = 4_000_000
#: Positions left free between two documents of a segment.
GAP = 64

_SPACED = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else ord(chr(c).lower()) if chr(c).isupper() else 0x20 for c in range(256))
INDEX = "segment string, doc_ids array<long>, n_words array<int>, terms array<binary>, counts array<int>, positions binary"


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII letters, lower-cased, ASCII digits and anything beyond ASCII."""
    return text.translate(_SPACED).split() if text else []


def _segments(lexicon: dict[bytes, int] | None):
    def run(batches):
        for ids, data, _ in slices(batches):
            split = [words(x) for x in data]
            sizes = np.array([len(x) for x in split], np.int64)
            known: dict[bytes, int] = {} if lexicon is None else lexicon
            if lexicon is None:
                for own in split:
                    for word in own:
                        known.setdefault(word, len(known))
            every = [w for own in split for w in own]
            term = np.fromiter(map(known.get, every, repeat(-1)), np.int32, len(every))
            place = np.arange(len(every)) + np.repeat(np.arange(len(split)) * GAP, sizes)
            at = np.flatnonzero(term >= 0)
            at = at[np.argsort(term[at], kind="stable")]
            found, counts = np.unique(term[at], return_counts=True)
            inverse = list(known)
            positions = place[at].astype("<i4")
            deltas = np.diff(positions, prepend=np.int32(0)).astype("<i4")  # compresses well; lists follow each other
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.int64())), pa.array([sizes.astype(np.int32)], pa.list_(pa.int32())),
                    pa.array([[inverse[k] for k in found.tolist()]], pa.list_(pa.binary())), pa.array([counts.astype(np.int32)], pa.list_(pa.int32())), pa.array([deltas.tobytes()], pa.binary()),
                ],
                names=["segment", "doc_ids", "n_words", "terms", "counts", "positions"],
            )

    return run


def _term_counts(wanted):
    def run(batches):
        total: Counter[bytes] = Counter()
        for batch in batches:
            for terms, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for term, n in zip(terms, counts, strict=True):
                    if term in wanted.value:
                        total[term] += n
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    return run


class Windows:
    """The windows of one block of benchmark items, their terms ordered from the rarest."""

    def __init__(self, items: list[tuple[str, list[bytes]]], size: int):
        owners: dict[tuple[bytes, ...], set[str]] = defaultdict(set)
        for item, own in items:
            for at in range(max(len(own) - size, 0) + 1 if own else 0):
                owners[tuple(own[at : at + size])].add(item)
        self.terms = {w: k for k, w in enumerate(dict.fromkeys(w for x in owners for w in x))}
        sets: dict[tuple[str, ...], int] = {}
        self.owner = np.fromiter((sets.setdefault(tuple(sorted(x)), len(sets)) for x in owners.values()), np.int32, len(owners))
        self.sets = list(sets)
        self.lengths = np.fromiter(map(len, owners), np.int32, len(owners))
        self.table = np.full((len(owners), size), len(self.terms), np.int32)  # the last column of `present` is always true
        for k, window in enumerate(owners):
            self.table[k, : len(window)] = [self.terms[w] for w in window]
        self.order = np.zeros(self.table.shape, np.min_scalar_type(size))

    def order_by(self, counts: dict[bytes, int]) -> None:
        rarity = np.array([counts.get(w, 0) for w in self.terms] + [np.iinfo(np.int64).max])
        for at in range(0, len(self.table), 65536):  # some rows at a time, as sorting works on eight bytes a term
            self.order[at : at + 65536] = np.argsort(rarity[self.table[at : at + 65536]], axis=1, kind="stable")


#: A match: start and end in words, whether exact, and the window.
Match = tuple[int, int, bool, int]


def _occurrences(windows: Windows, slop: int, segment: dict) -> dict[int, list[Match]]:
    """The matches by document of the segment; one within the slop is placed by its rarest term."""
    counts = np.asarray(segment["counts"], np.int64)
    ends = np.cumsum(counts)
    positions = np.cumsum(np.frombuffer(segment["positions"], "<i4"), dtype=np.int64)
    lists: dict[int, np.ndarray] = {}
    present = np.zeros(len(windows.terms) + 1, bool)
    present[-1] = True
    for k, term in enumerate(segment["terms"]):
        if (own := windows.terms.get(term)) is not None:
            lists[own] = positions[ends[k] - counts[k] : ends[k]]
            present[own] = True
    sizes = np.asarray(segment["n_words"], np.int64)
    firsts = np.cumsum(sizes) - sizes + np.arange(len(sizes)) * GAP
    found_in: dict[int, list[Match]] = defaultdict(list)
    for k in np.flatnonzero(present[windows.table].all(axis=1)).tolist():
        length = int(windows.lengths[k])
        places = [(lists[int(windows.table[k, at])], at) for at in windows.order[k, :length].tolist()]
        starts = places[0][0] - places[0][1]
        for own, at in places[1:]:
            found = np.searchsorted(own, starts + (at - slop))
            starts = starts[(found < len(own)) & (own[np.minimum(found, len(own) - 1)] <= starts + (at + slop))]
            if not len(starts):
                break
        if not len(starts):
            continue
        right = np.ones(len(starts), bool)
        for own, at in places:
            found = np.minimum(np.searchsorted(own, starts + at), len(own) - 1)
            right &= own[found] == starts + at
        doc = np.searchsorted(firsts, starts + places[0][1], side="right") - 1
        for d, start, whole in zip(doc.tolist(), (starts - firsts[doc]).tolist(), right.tolist(), strict=True):
            found_in[d].append((max(start, 0), min(start + length, int(sizes[d])), whole, k))
    return found_in


#: What one block of the benchmark finds in a document: matches as columns, and the sets of items that share a window.
PART = "struct<starts: array<int>, ends: array<int>, exact: array<boolean>, owner: array<int>, owners: array<array<string>>>"
_PART = pa.struct([("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("exact", pa.list_(pa.bool_())), ("owner", pa.list_(pa.int32())), ("owners", pa.list_(pa.list_(pa.string())))])
RESULT = f"segment string, at int, doc_id long, n_words long, parts array<{PART}>"


def _part(matches: list[Match], windows: Windows) -> dict:
    numbers: dict[int, int] = {}
    owner = [numbers.setdefault(int(windows.owner[k]), len(numbers)) for *_, k in matches]
    starts, ends, exact, _ = zip(*matches, strict=True)
    return {"starts": starts, "ends": ends, "exact": exact, "owner": owner, "owners": [windows.sets[x] for x in numbers]}


def _asked(windows, slop: int):
    def run(batches):
        for batch in batches:
            for segment in batch.to_pylist():
                found = _occurrences(windows.value, slop, segment)
                n = len(segment["doc_ids"])
                columns = [
                    pa.array([segment["segment"]] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(segment["doc_ids"], pa.int64()), pa.array(segment["n_words"], pa.int64()),
                    pa.array([[_part(found[d], windows.value)] if d in found else [] for d in range(n)], pa.list_(_PART)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["segment", "at", "doc_id", "n_words", "parts"])

    return run


def _digest(parts: list[dict]) -> tuple[int, int, str, bool, int]:
    spans, items, near = [], set(), set()
    for part in parts:
        for exact in (True, False):
            own = {o for o, whole in zip(part["owner"], part["exact"], strict=True) if whole is exact}
            (items if exact else near).update(x for o in own for x in part["owners"][o])
        spans += [(a, b) for a, b, whole in zip(part["starts"], part["ends"], part["exact"], strict=True) if whole]
    total = last = 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, last))
        last = max(last, b)
    return total, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), total > 0, len(near - items)


def _digests(batches):
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.int64())
    for batch in batches:
        parts = batch.column(batch.schema.get_field_index("parts")).to_pylist()
        columns = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "n_words")]
        columns += [pa.array(x, kind) for x, kind in zip(zip(*map(_digest, parts), strict=True), kinds, strict=True)] if parts else [pa.array([], kind) for kind in kinds]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near_items"])


def _blocks(benchmark: DataFrame, block_bytes: int) -> tuple[int, DataFrame]:
    rows = benchmark.where(F.col("text").isNotNull()).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("string").cast("binary").alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // block_bytes) or 1
    return n, rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(n)))


def _items(rows: DataFrame, block: int) -> list[tuple[str, list[bytes]]]:
    return [(r["item"], words(bytes(r["text"]))) for r in rows.where(F.col("block") == block).collect()]  # a block's size is bounded


def build_index(docs: DataFrame, scratch: Scratch, lexicon: dict[bytes, int] | None = None) -> DataFrame:
    """The segments; with a lexicon, only of its terms."""
    return scratch.table(map_arrow(texts(docs), _segments(lexicon), INDEX), "index")


def _found(docs: DataFrame, benchmark: DataFrame, window: int, slop: int, block_bytes: int) -> tuple[DataFrame, bool]:
    """Rows of RESULT, one for each document and block, and whether there are several blocks."""
    if window + 2 * slop >= GAP:
        raise ValueError("the window and the slop must be shorter than the gap between documents")
    spark = docs.sparkSession
    n, rows = _blocks(benchmark, block_bytes)
    whole = Windows(_items(rows, 0), window) if n == 1 else None
    index = build_index(docs, Scratch(spark, "decontamination"), whole.terms if whole else None)
    asked = [_ask(spark, index, whole or Windows(_items(rows, block), window), slop) for block in range(n)]
    return reduce(DataFrame.unionByName, asked), n > 1


def find_matches(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, slop: int = SLOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each place and item: doc_id, item_id, start, end (in words, exclusive), exact.

    An exact match has the window's words in order. One that isn't has each word within the slop of its place, counted
    from the window's rarest word; start and end are those of the window so placed, cut to the document. Documents
    without a match have no row. Nulls, repeated rows and empty tables are as in decontaminate(); documents of any
    length are asked whole.
    """
    found, _ = _found(docs, benchmark, window, slop, block_bytes)
    part = found.select("doc_id", F.explode("parts").alias("p")).where("size(p.starts) > 0")
    match = part.select("doc_id", "p.owners", F.explode(F.arrays_zip(F.col("p.starts").alias("start"), F.col("p.ends").alias("end"), F.col("p.exact").alias("exact"), F.col("p.owner").alias("owner"))).alias("m"))
    return match.select("doc_id", F.explode(F.col("owners")[F.col("m.owner")]).alias("item_id"), "m.start", "m.end", "m.exact")


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, slop: int = SLOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, n_near_items.

    n_near_items counts items with a window that the document has within the slop, and with none that it has exactly.
    Null texts have no words. Benchmark rows of one item_id are one item; a null item_id is written as an empty string.
    Rows that repeat a doc_id each get their own row. An empty benchmark hits nothing. A document of any length is
    asked whole; windows that several items share count for each. An empty table of documents gives no rows. Columns
    other than doc_id and text, or item_id and text, are left behind, whatever their names.
    """
    found, several = _found(docs, benchmark, window, slop, block_bytes)
    if several:
        found = found.groupBy("segment", "at").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.flatten(F.collect_list("parts")).alias("parts"))
    return map_arrow(
        found.select("doc_id", "n_words", "parts"), _digests,
        "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, n_near_items long",
    )


def _ask(spark: SparkSession, index: DataFrame, windows: Windows, slop: int) -> DataFrame:
    wanted = spark.sparkContext.broadcast(frozenset(windows.terms))  # bounded by a block of the benchmark
    counts = map_arrow(index.select("terms", "counts"), _term_counts(wanted), "term binary, n long").groupBy("term").agg(F.sum("n").alias("n"))
    windows.order_by({bytes(r["term"]): r["n"] for r in counts.collect()})  # no more rows than the block has terms
    return map_arrow(index, _asked(spark.sparkContext.broadcast(windows), slop), RESULT)


def clean_documents(docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW) -> DataFrame:
    """The rows without an exact match, with all their columns."""
    rows, _ = with_rows(docs, Scratch(docs.sparkSession, "clean_documents"))
    hit = decontaminate(by_row(rows), benchmark, window=window).where("contaminated").select(F.col("doc_id").alias(ROW))
    return rows.join(hit, ROW, "left_anti").select(*own_columns(docs))
