"""Best-fit packing by linear grouping.

A piece's length is an integer up to the capacity, so the corpus enters the plan only as the number of pieces of each
length. Large lengths are rounded up within groups of equal cardinality. Which configurations of the rounded sizes are
used how often is the optimum of the linear program over all configurations, found by column generation (a knapsack prices
them); what rounding it down leaves over is placed by subset sums. Each configuration's places take the longest actual
lengths that they and the room left before them have room for, so what rounding up cost is given back; small pieces go,
longest first, to the sequences they fit best. Plans with other groups, and by subset sums of all lengths alone, are made
too, and the one with fewest sequences is taken. A plan is runs of equal sequences: its size depends on the capacity and
not on the corpus. A join by length and rank gives each piece its place.
"""

from __future__ import annotations

import bisect
import heapq
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, map_arrow, partitions_for, slices, texts
from tidemark.llm.tokens import CACHE, default_path, document_ids

CAPACITY = 1024
#: Large lengths form at most so many groups for the linear program, small ones being at most LARGE of the capacity; for
#: subset sums alone each length is a group, and small ones are at most SMALL_PARTS of it.
GROUPS, LARGE, SMALL_PARTS = (160, 1024), 4, (4, 8, 16, 64)
#: By how much a configuration must be worth more than a sequence to enter the basis.
EPSILON = 1e-7


def piece_bounds(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of each piece: only the first may be shorter than the capacity."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def _pieces(path: str, capacity: int):
    def run(batches):
        for ids, data, _ in slices(batches, keep=CACHE):
            out, begin = [], 0
            tokens, ends = document_ids(data, path)
            encoded = memoryview(tokens.astype("<u4").tobytes())
            for doc_id, end in zip(ids, ends.tolist(), strict=True):
                out += [(doc_id, k, at, n, zlib.crc32(encoded[4 * (begin + at) : 4 * (begin + at + n)])) for k, (at, n) in enumerate(piece_bounds(end - begin, capacity))]
                begin = end
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def grouped(counts: dict[int, int], groups: int) -> dict[int, int]:
    """Length to rounded length: groups of equal cardinality, each rounded up to its longest; a length is in one group."""
    out, total, seen, top, group = {}, sum(counts.values()), 0, None, None
    for length in sorted(counts, reverse=True):
        if (now := seen * groups // total) != group:
            group, top = now, length
        out[length] = top
        seen += counts[length]
    return out


def _complement(sizes: list[int], have: dict[int, int], room: int) -> list[int]:
    """Sizes, no more of each than there are, whose sum is the largest up to room; one size if one fills it, else two, else more."""
    fits = [s for s in sizes if s <= room]
    if not fits or fits[-1] == room:
        return fits[-1:]
    kept = set(fits)
    best: list[int] = [fits[-1]]
    for s in reversed(fits):
        rest = room - s
        at = bisect.bisect_right(fits, rest) - 1
        if at >= 0 and (fits[at] != s or have[s] > 1):
            if s + fits[at] > sum(best):
                best = [s, fits[at]]
            if sum(best) == room:
                return best
    reach, masks = 1, []  # subset sums as bits; then the choice is read backwards
    window = (1 << room + 1) - 1
    for s in reversed(fits):
        for _ in range(min(have[s], room // s, 3)):
            masks.append((s, reach))
            reach |= reach << s & window
    target = reach.bit_length() - 1
    if target <= sum(best):
        return best
    chosen = []
    for s, before in reversed(masks):
        if not before >> target & 1:
            chosen.append(s)
            target -= s
    assert kept.issuperset(chosen)
    return chosen


def _descending(sizes: list[int], have: dict[int, int], room: int) -> list[int]:
    """The largest size that fits, again and again."""
    chosen: list[int] = []
    at = len(sizes)
    while room and (at := bisect.bisect_right(sizes, room, 0, at) - 1) >= 0:
        times = min(have[sizes[at]], room // sizes[at])
        chosen += [sizes[at]] * times
        room -= sizes[at] * times
    return chosen


def optimised(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(sizes, how many sequences): the least linear combination of configurations that holds all sizes, rounded down."""
    sizes = np.array(sorted(counts, reverse=True), np.int64)
    if not len(sizes):
        return []
    demand = np.array([counts[s] for s in sizes.tolist()], np.int64)
    basis, amounts = linear_program(sizes, demand, capacity)
    times = np.floor(np.maximum(amounts, 0) + 1e-7).astype(np.int64)
    out, left = [], demand.copy()
    for column, n in zip(basis.T.astype(np.int64), times.tolist(), strict=True):
        need = np.flatnonzero(column)
        n = min(n, int((left[need] // column[need]).min()))  # whatever rounding did, no more than there are
        if n:
            left -= n * column
            out.append((np.repeat(sizes, column).tolist(), n))
    return out


def linear_program(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """A basis of configurations, one a size, and how often each is used: the optimum, as no configuration is worth more
    than a sequence at its prices.

    It begins with the configurations that subset sums find one after the other. The configuration that is worth most
    enters the basis while it is worth more than one. Demands are raised by tiny amounts, all different, so that each
    step lowers the sum and none is taken twice. The basis's inverse is kept and made anew from time to time.
    """
    n, place = len(sizes), {int(x): k for k, x in enumerate(sizes)}
    basis = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1.0 / (capacity // sizes))
    wanted = demand + 1e-5 * (1 + (np.arange(n) * 0.6180339887498949) % 1)
    begun = []
    for pattern, _ in configurations(dict(zip(sizes.tolist(), demand.tolist(), strict=True)), capacity):
        column = np.zeros(n)
        np.add.at(column, [place[x] for x in pattern], 1)
        begun.append(column)
    steps = 0
    while True:
        prices = inverse.sum(axis=0)
        worth = [float(c @ prices) for c in begun]
        if begun and max(worth) > 1 + EPSILON:
            entering = begun[int(np.argmax(worth))]
        else:
            begun = []
            entering = _most_worth(sizes, prices, capacity)
            if entering @ prices <= 1 + EPSILON:
                return basis, inverse @ demand
        direction, amounts = inverse @ entering, np.maximum(inverse @ wanted, 0)
        ratios = np.where(direction > 1e-9, amounts / np.where(direction > 1e-9, direction, 1), np.inf)
        leaving = int(np.argmin(ratios))
        basis[:, leaving] = entering
        row = inverse[leaving] / direction[leaving]
        inverse -= np.outer(direction, row)
        inverse[leaving] = row
        steps += 1
        if steps % 200 == 0:
            inverse = np.linalg.inv(basis)


def _most_worth(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """How many of each size are worth most together, up to the capacity."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1, np.int64)
    order = np.argsort(sizes, kind="stable")
    small, worth = sizes[order], prices[order]
    fitting = np.searchsorted(small, np.arange(capacity + 1), side="right")
    for room in range(int(small[0]), capacity + 1):
        own = best[room - small[: fitting[room]]] + worth[: fitting[room]]
        k = int(np.argmax(own))
        best[room], last[room] = (own[k], k) if own[k] > best[room - 1] else (best[room - 1], -1)
    out, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if last[room] >= 0:
            out[order[last[room]]] += 1
            room -= int(small[last[room]])
        else:
            room -= 1
    return out


def configurations(counts: dict[int, int], capacity: int, complement=_complement, first: list[tuple[list[int], int]] | None = None) -> list[tuple[list[int], int]]:
    """(sizes, how many sequences): those of `first`; then the largest size left is joined by its complement, as often as all of them last."""
    have, out = dict(counts), list(first or [])
    for pattern, times in out:
        for s in pattern:
            have[s] -= times
    sizes = sorted(s for s in have if have[s])
    while sizes:
        top = sizes[-1]
        have[top] -= 1
        if not have[top]:
            sizes.pop()
        rest = complement(sizes, have, capacity - top)
        have[top] += 1
        pattern = [top, *rest]
        need = {s: pattern.count(s) for s in pattern}
        times = min(have[s] // k for s, k in need.items())
        for s, k in need.items():
            have[s] -= k * times
        sizes = [s for s in sizes if have[s]] if have[top] == 0 or top in sizes else [*[s for s in sizes if have[s]], top]
        out.append((pattern, times))
    return out


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, end rank, first sequence, offset): the ranks of a length go to consecutive sequences."""
    return min((found for _, found in plans(counts, capacity, groups)), key=lambda x: x[0])[1]


def plans(counts: dict[int, int], capacity: int = CAPACITY, groups: tuple[int, ...] = GROUPS):
    """What each plan is made of, how many sequences it has, and itself. Of equal ones the linear program's are first."""
    for part, n, by in [(LARGE, n, "linear program") for n in groups] + [(part, capacity, "subset sums") for part in SMALL_PARTS]:
        large = {x: c for x, c in counts.items() if x > capacity // part}
        sizes: dict[int, int] = defaultdict(int)
        for x, top in grouped(large, n).items():
            sizes[top] += large[x]
        first = optimised(dict(sizes), capacity) if by == "linear program" else []
        for way in (_complement, _descending):
            yield by, _plan(counts, capacity, capacity // part, configurations(dict(sizes), capacity, way, first))


def _plan(counts: dict[int, int], capacity: int, small_most: int, found: list[tuple[list[int], int]]) -> tuple[int, list[tuple[int, int, int, int, int]]]:
    """How many sequences, and where: actual lengths in the places of the configurations, then the small ones."""
    have = {n: c for n, c in counts.items() if n > small_most}
    lengths = sorted(have)
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    runs: list[tuple[int, int, int]] = []  # room, first sequence, sequences
    for pattern, times in found:
        while times and lengths:
            # The longest lengths that places of these sizes have room for, with the room that those before them left.
            chosen, spare = [], capacity - sum(pattern)
            for s in sorted(pattern, reverse=True):
                spare += s
                k = bisect.bisect_right(lengths, spare)
                while k and have[lengths[k - 1]] <= chosen.count(lengths[k - 1]):
                    k -= 1
                if k:
                    chosen.append(lengths[k - 1])
                    spare -= lengths[k - 1]
            # as many sequences as have the same lengths
            take = min([times, *(have[x] // chosen.count(x) for x in set(chosen))]) if chosen else times
            offset = 0
            for length in chosen:
                out.append((length, used[length], used[length] + take, sequence, offset))
                used[length] += take
                have[length] -= take
                offset += length
            lengths = [x for x in lengths if have[x]] if any(not have[x] for x in chosen) else lengths
            times -= take
            if not chosen:
                continue
            if offset < capacity:
                runs.append((capacity - offset, sequence, take))
            sequence += take
    assert not lengths  # places of a size or more are as many as pieces of it or longer ones
    rooms: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for room, first, n in runs:
        rooms[room].append((first, n))
    fits = sorted(rooms)
    for length in sorted((n for n in counts if n <= small_most), reverse=True):
        left = counts[length]
        while left:
            at = bisect.bisect_left(fits, length)
            if at == len(fits):  # new sequences, each filled with this length
                each = capacity // length
                full = -(-left // each)
                rooms[capacity].append((sequence, full))
                bisect.insort(fits, capacity)
                sequence += full
                continue
            room = fits[at]
            first, n = rooms[room].pop()
            each, opened = room // length, min(n, left)
            if not rooms[room]:
                fits.pop(at)
            if opened < n:
                _give(rooms, fits, room, (first + opened, n - opened))
            layers = min(each, left // opened)
            for k in range(layers):
                out.append((length, used[length], used[length] + opened, first, capacity - room + k * length))
                used[length] += opened
            left -= layers * opened
            if room - layers * length:
                _give(rooms, fits, room - layers * length, (first, opened))
    return sequence, out


def _give(rooms: dict[int, list[tuple[int, int]]], fits: list[int], room: int, run: tuple[int, int]) -> None:
    if not rooms[room]:
        bisect.insort(fits, room)
    heapq.heappush(rooms[room], run)


def pack(docs: DataFrame, *, capacity: int = CAPACITY, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is an empty one: its piece is the end id. Rows that repeat a doc_id, or have none, are packed as documents
    of their own. A text longer than the capacity is cut in pieces; its ids are encoded whole. Pieces of one length are
    placed by doc_id, piece and checksum within a bucket of their hash; equal ones are alike. An empty table gives no rows.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    pieces = scratch.table(map_arrow(texts(docs), _pieces(tokenizer or default_path(), capacity), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    places = spark.createDataFrame(plan(counts, capacity), "length long, first long, until long, sequence long, offset long")
    # A length may have most of the rows: they are ranked in as many buckets as rows ask for.
    buckets = partitions_for(spark, sum(counts.values()), 20_000)
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("length", "bucket", (F.sum("n").over(Window.partitionBy("length").orderBy("bucket")) - F.col("n")).alias("before"))
    ranked = dealt.withColumn("inside", F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1)
    ranked = ranked.join(before, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("inside")).alias("r")
    at = F.broadcast(places).alias("p")  # its size depends on the capacity only
    found = ranked.join(at, (F.col("r.length") == F.col("p.length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("until")))
    return found.select(
        "doc_id", "piece", "start", F.col("r.length").alias("length"), "ids_crc32", (F.col("sequence") + F.col("rank") - F.col("first")).alias("sequence_id"), "offset"
    )
