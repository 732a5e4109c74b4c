"""Which 64-bit or 128-bit keys repeat, found by exchanging packed arrays of keys.

Each task keeps its keys once and writes, as a row of packed arrays named by (flush, part), those of each part of the
key space, with the documents and places that they came from. A group of the keys of one part finds those that repeat;
each key comes at most once from a flush, so a key that a third of all documents share weighs no more than any other.
What was found goes back to the row that it came from as positions among the row's keys, and no group ever holds the
documents of a key.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import trim

#: Keys that a task holds before it writes them.
FLUSH = 600_000
#: Parts at least: with many, a document's keys lie in parts of their own at any size of the corpus.
LEAST_PARTS, PART_KEYS = 64, 1_000_000
HELD = "flush long, part int, keys binary, more binary, times binary, entry_key binary, entry_place binary, counts binary, docs binary"
HELD_NAMES = [x.split()[0] for x in HELD.split(", ")]


def parts_for(keys: int) -> int:
    return max(LEAST_PARTS, -(-keys // PART_KEYS))


def _parts_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _first(sorted_: list[np.ndarray]) -> np.ndarray:
    """Where a new value of the sorted columns begins."""
    new = np.ones(len(sorted_[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_])
    return new


class Held:
    """Keys of a task's documents until they are written."""

    def __init__(self, parts: int):
        self.parts, self.size = parts, 0
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.docs: list[bytes] = []

    def add(self, docs: list[bytes], high: np.ndarray, low: np.ndarray, doc: np.ndarray, place: np.ndarray, several: np.ndarray, route: np.ndarray | None = None) -> None:
        """docs: names of one width; doc: indices in docs, ascending, and places ascending in each; low: empty for
        64-bit keys; several: the key stands for more occurrences than this one; route: what decides the part, equal for
        equal keys."""
        part = _parts_of(high if route is None else route, self.parts).astype(np.int32)
        self.columns.append((high, low, (doc + len(self.docs)).astype(np.int32), place.astype(np.int32), several, part))
        self.docs += docs
        self.size += len(high)

    def rows(self) -> pa.RecordBatch:
        high, low, doc, place, several, part_of = (np.concatenate(x) for x in zip(*self.columns, strict=True))
        self.columns.clear()
        wide = bool(len(low))
        order = np.lexsort((low, high)) if wide else np.argsort(high, kind="stable")
        new = _first([high[order], low[order]] if wide else [high[order]])
        starts = np.flatnonzero(new)
        times = (np.diff(np.append(starts, len(high))) + np.logical_or.reduceat(several[order], starts)).astype("<u4")
        group = np.empty(len(high), np.int32)  # of each entry, in the order of documents
        group[order] = np.cumsum(new) - 1
        by_part = np.argsort(part_of, kind="stable")  # a part's entries stay in the order of documents
        bounds = np.searchsorted(part_of[by_part], np.arange(self.parts + 1)).tolist()
        flush = uuid.uuid4().int >> 65
        out = [(flush, -1, None, None, None, None, None, None, b"".join(self.docs))]
        for part, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
            if x == y:
                continue
            entries = by_part[x:y]
            own, at, back = np.unique(group[entries], return_index=True, return_inverse=True)
            rank = np.argsort(np.argsort(at))  # keys in the order in which they come first: their numbers then rise by one
            keys = np.empty(len(own), np.int64)
            keys[rank] = own
            first = order[starts[keys]]
            docs, begin = np.unique(doc[entries], return_index=True)
            out.append((
                flush, part, high[first].tobytes(), low[first].tobytes() if wide else b"", times[keys].tobytes(),
                np.diff(rank[back], prepend=0).astype("<i4").tobytes(), np.diff(place[entries], prepend=0).astype("<i4").tobytes(),
                np.diff(np.append(begin, y - x)).astype("<u4").tobytes(), np.diff(docs, prepend=0).astype("<u4").tobytes(),
            ))
        types = (pa.int64(), pa.int32(), *[pa.binary()] * 7)
        del high, low, doc, place, several, part_of, order, new, times, group, by_part
        trim()
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=HELD_NAMES)


def _repeated(table: pa.Table) -> pa.Table:
    """Keys that occur twice or more over all flushes, and how often."""
    flush, part, keys, more, times = (table.column(c).to_pylist() for c in ("flush", "part", "keys", "more", "times"))
    arrays = [np.frombuffer(x, "<u8") for x in keys]
    key = np.concatenate(arrays)
    wide = bool(more and more[0])
    low = np.concatenate([np.frombuffer(x, "<u8") for x in more]) if wide else key
    order = np.lexsort((low, key)) if wide else np.argsort(key, kind="stable")
    new = _first([key[order], low[order]] if wide else [key[order]])
    total = np.add.reduceat(np.concatenate([np.frombuffer(x, "<u4") for x in times])[order].astype(np.int64), np.flatnonzero(new))
    totals = np.empty(len(key), "<u4")
    totals[order] = np.minimum(total, (1 << 32) - 1)[np.cumsum(new) - 1]
    at = np.flatnonzero(totals > 1)
    first = np.cumsum([0, *map(len, arrays)])
    bounds = np.searchsorted(at, first).tolist()
    out = [(flush[k], part[k], (at[a:b] - first[k]).astype("<u4").tobytes(), totals[at[a:b]].tobytes()) for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if b > a]
    columns = list(zip(*out, strict=True)) if out else [[], [], [], []]
    return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["flush", "part", "found", "totals"])


def _places(batches):
    """For each document of a row its repeated keys, how often they occur, and their places."""
    for batch in batches:
        for flush, keys, entry_key, entry_place, counts, docs, found, totals in zip(*(batch.column(k).to_pylist() for k in range(8)), strict=True):
            total = np.zeros(len(keys) // 8, "<u4")
            total[np.frombuffer(found, "<u4")] = np.frombuffer(totals, "<u4")
            wanted = total > 0
            key = np.cumsum(np.frombuffer(entry_key, "<i4"), dtype=np.int64)
            hit = wanted[key]
            place = np.cumsum(np.frombuffer(entry_place, "<i4"), dtype=np.int64).astype("<u4")[hit]
            values, often = np.frombuffer(keys, "<u8")[key[hit]], total[key[hit]]
            bounds = np.concatenate([[0], np.cumsum(hit)])[np.cumsum([0, *np.frombuffer(counts, "<u4")])].tolist()
            doc = np.cumsum(np.frombuffer(docs, "<u4"), dtype=np.int64).tolist()
            out = [(flush, d, values[a:b].tobytes(), often[a:b].tobytes(), place[a:b].tobytes()) for d, a, b in zip(doc, bounds[:-1], bounds[1:], strict=True) if b > a]
            if out:
                types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["flush", "doc", "values", "totals", "places"])


def _tallies(batches):
    """For each document of a row how many of its entries have a key that repeats."""
    for batch in batches:
        for flush, entry_key, counts, docs, found in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            key = np.cumsum(np.frombuffer(entry_key, "<i4"), dtype=np.int64)
            wanted = np.zeros(int(key.max()) + 1, bool)
            wanted[np.frombuffer(found, "<u4")] = True
            n = np.diff(np.concatenate([[0], np.cumsum(wanted[key])])[np.cumsum([0, *np.frombuffer(counts, "<u4")])])
            doc = np.cumsum(np.frombuffer(docs, "<u4"), dtype=np.int64)[n > 0]
            yield pa.RecordBatch.from_arrays([pa.array([flush] * len(doc), pa.int64()), pa.array(doc), pa.array(n[n > 0].astype(np.int64))], names=["flush", "doc", "n_repeated"])


def _names(width: int):
    def run(batches):
        for batch in batches:
            for flush, docs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(docs) // width
                yield pa.RecordBatch.from_arrays([pa.array([flush] * n, pa.int64()), pa.array(range(n), pa.int64()), pa.array([docs[width * k : width * (k + 1)] for k in range(n)], pa.binary())], names=["flush", "doc", "rid"])

    return run


def repeated_counts(keys: DataFrame, width: int) -> DataFrame:
    """rid, n_repeated: how many of a document's keys repeat; documents without any are absent."""
    held = keys.where("part >= 0")
    found = held.select("flush", "part", "keys", "more", "times").groupBy("part").applyInArrow(_repeated, "flush long, part int, found binary, totals binary")
    rows = held.select("flush", "part", "entry_key", "counts", "docs").join(found.select("flush", "part", "found"), ["flush", "part"])
    tallies = rows.select("flush", "entry_key", "counts", "docs", "found").mapInArrow(_tallies, "flush long, doc long, n_repeated long")
    names = keys.where("part < 0").select("flush", "docs").mapInArrow(_names(width), "flush long, doc long, rid binary")
    return tallies.groupBy("flush", "doc").agg(F.sum("n_repeated").alias("n_repeated")).join(names, ["flush", "doc"]).select("rid", "n_repeated")


def repeated_places(keys: DataFrame, what: list[str], width: int) -> DataFrame:
    """rid and `lists`, structs of packed arrays (`values`, `totals`, `places`) of its keys that repeat. keys: a written
    table of HELD.

    width: bytes of a document's name. A name that a task or several held more than once has several rows.
    """
    held = keys.where("part >= 0")
    found = held.select("flush", "part", "keys", "more", "times").groupBy("part").applyInArrow(_repeated, "flush long, part int, found binary, totals binary")
    rows = held.select("flush", "part", "keys", "entry_key", "entry_place", "counts", "docs").join(found, ["flush", "part"])
    rows = rows.select("flush", "keys", "entry_key", "entry_place", "counts", "docs", "found", "totals").mapInArrow(_places, "flush long, doc long, values binary, totals binary, places binary")
    lists = rows.groupBy("flush", "doc").agg(F.collect_list(F.struct(*what)).alias("lists"))
    names = keys.where("part < 0").select("flush", "docs").mapInArrow(_names(width), "flush long, doc long, rid binary")
    return lists.join(names, ["flush", "doc"]).select("rid", "lists")
