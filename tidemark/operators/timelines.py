"""Time lines that no task holds whole: numbering, greedy cuts, islands, and joins of spans of very different lengths.

What a row needs from before it is carried over summaries: rows are numbered, and their latest end is found, within a
bucket of time, and the buckets' counts and latest ends are added up over one row a bucket. Greedy cuts, where a group's
limit starts anew after each cut, are found in chunks of consecutive rows: each row's next cut does not depend on where
groups before it began, so all of them are found at once, chunks are crossed by pointers from each possible entry to the
next one, and pointer doubling over written tables finds the entries that the first row leads to.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.generations import Put, Store, shared_folder

#: Seconds of a bucket in which rows are numbered, and rows of a chunk in which cuts are followed.
BUCKET_S, CHUNK = 3600.0, 4096


@dataclass(frozen=True)
class Rule:
    """When a group that began at a row is cut at one of the rows from it on: where `ends` is true, at max_items rows,
    or where the row's t_end is max_s (more than it, if strict) after the first row's t_start. `after`: the row is the
    group's last one; else it begins the next group, and a first row is never cut before itself. `ends` counts only from
    where the group has min_items rows."""

    after: bool
    max_s: float | None = None
    max_items: int | None = None
    strict: bool = False
    min_items: int = 0


def _written(spark, df: DataFrame, at: Store, name: str) -> DataFrame:
    at.commit({name: Put(df)})
    return at.read(name)


def _own_store(spark) -> Store:
    return Store(spark, f"{shared_folder(spark)}/timelines/{uuid.uuid4().hex}")


def numbered(rows: DataFrame, order: list[str], *, key: str = "video_id", bucket_s: float = BUCKET_S) -> DataFrame:
    """rows with `pos`, their number from 0 in the order of the columns (t_start first) in each video; nulls come first.

    Rows are sorted within buckets of time only.
    """
    placed = rows.withColumn("_bucket", F.coalesce(F.floor(F.col("t_start") / bucket_s), F.lit(-(1 << 62))))
    counts = placed.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    within = placed.withColumn("_in", F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(*order)))
    met = within.join(offsets.withColumnRenamed(key, "_key"), F.col(key).eqNullSafe(F.col("_key")) & (within["_bucket"] == offsets["_bucket"]))
    return met.withColumn("pos", F.col("_offset") + F.col("_in") - 1).select(*rows.columns, "pos")


# --- greedy cuts --------------------------------------------------------------------------------------------------

_CHUNKS = "video string, is_null boolean, chunk long, last boolean, t_start array<double>, t_end array<double>, ends array<boolean>"
_OPEN = "video string, is_null boolean, chunk long, start long, first double, n long"
_NEXT = "video string, is_null boolean, chunk long, start long, cut long"


class _Cuts:
    """The first cut of groups among the rows of a chunk."""

    def __init__(self, rule: Rule, t_end: np.ndarray, ends: np.ndarray):
        self.rule, self.t_end, self.ends = rule, t_end, ends
        self.stack: list[int] = []  # rows from `at` on whose end no earlier one of them reaches, the nearest last
        self.marks: list[int] = []  # rows where `ends` is true from `at` on, the nearest last
        self.at = len(t_end)

    def _back(self) -> None:
        """Looks one row further back."""
        self.at -= 1
        k, end = self.at, self.t_end[self.at]
        if not np.isnan(end):
            while self.stack and self.t_end[self.stack[-1]] <= end:
                self.stack.pop()
            self.stack.append(k)
        if self.ends[k]:
            self.marks.append(k)

    def back_to(self, k: int) -> None:
        while self.at > k:
            self._back()

    def cut(self, first: float | None, n: int) -> int:
        """The first of the rows from `at` on at which a group is cut that began at the time `first` and has n rows so
        far; the number of rows if it isn't cut."""
        found = len(self.t_end)
        if self.marks:
            least = self.at + max(0, self.rule.min_items - n - (1 if self.rule.after else 0))
            far = bisect_left(self.marks, True, key=lambda k: k < least)
            if far:
                found = self.marks[far - 1]
        if self.rule.max_items is not None:
            found = min(found, max(self.at, self.at + self.rule.max_items - n - (1 if self.rule.after else 0)))
        if self.rule.max_s is not None and first is not None and not np.isnan(first):
            most, end = self.rule.max_s, self.t_end
            over = (lambda k: end[k] - first <= most) if self.rule.strict else (lambda k: end[k] - first < most)
            reach = bisect_left(self.stack, True, key=over)
            if reach:
                found = min(found, self.stack[reach - 1])
        return found


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(batch.num_rows):
            yield {name: batch.column(c)[k] for c, name in enumerate(batch.schema.names)}


def _array(x: pa.Scalar, kind) -> np.ndarray:
    return np.array([np.nan if v is None and kind is float else v or 0 for v in x.as_py() or []], kind)


def _path(rule: Rule, t_start: list, t_end: list, ends: list) -> list[tuple[int, int]]:
    """The groups that the first row leads to, each with its cut, by one pass over the rows; the last one's cut is their
    number, and is open if the rows go on."""
    out, k, n = [], 0, len(t_end)
    least, most, reach = rule.min_items, rule.max_items, rule.max_s
    while k < n:
        first, j = t_start[k], k if rule.after else k + 1
        while j < n:
            rows = j - k + (1 if rule.after else 0)
            if ends[j] and rows >= least or most is not None and rows >= most:
                break
            if reach is not None and first is not None and t_end[j] is not None:
                length = t_end[j] - first
                if length > reach or length == reach and not rule.strict:
                    break
            j += 1
        cut = min(j + 1, n) if rule.after else j
        out.append((k, cut if j < n else n + 1))
        k = cut
    return out


def _found(rule: Rule, size: int):
    """For each row of each chunk where its group is cut; groups that aren't cut in the chunk stay open. A time line's first
    chunk is entered at its first row only, so just the groups that this one leads to are found there."""

    def run(batches):
        for r in _rows_of(batches):
            starts, base, last, out = r["t_start"].as_py(), r["chunk"].as_py() * size, r["last"].as_py(), []
            n = len(starts)
            if base == 0:
                for k, at in _path(rule, starts, r["t_end"].as_py(), r["ends"].as_py()):
                    out.append((k, at, None, None) if at <= n else (k, n if last else None, starts[k], n - k))
            else:
                cuts = _Cuts(rule, _array(r["t_end"], float), _array(r["ends"], bool))
                for k in range(n - 1, -1, -1):
                    cuts.back_to(k if rule.after else k + 1)
                    at = cuts.cut(starts[k], 0 if rule.after else 1)
                    if at < n:
                        out.append((base + k, base + at + (1 if rule.after else 0), None, None))
                    else:
                        out.append((base + k, base + n if last else None, starts[k], n - k))
            columns = list(zip(*out, strict=True))
            same = [pa.array([r[c].as_py()] * len(out), t) for c, t in (("video", pa.string()), ("is_null", pa.bool_()), ("chunk", pa.int64()))]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True))], names=["video", "is_null", "chunk", "start", "cut", "first", "n"])

    return run


def _continued(rule: Rule, size: int):
    """Groups that are open at the end of the chunk before: where they are cut in this one, if they are."""

    def run(batches):
        for r in _rows_of(batches):
            ends_at, base, out = _array(r["t_end"], float), r["chunk"].as_py() * size, []
            cuts = _Cuts(rule, ends_at, _array(r["ends"], bool))
            cuts.back_to(0)
            for start, first, n in ((x["start"], x["first"], x["n"]) for x in r["open"].as_py()):
                at = cuts.cut(first, n)
                if at < len(ends_at):
                    out.append((start, base + at + (1 if rule.after else 0), None, None))
                else:
                    out.append((start, base + len(ends_at) if r["last"].as_py() else None, first, n + len(ends_at)))
            columns = list(zip(*out, strict=True))
            same = [pa.array([r[c].as_py()] * len(out), t) for c, t in (("video", pa.string()), ("is_null", pa.bool_()), ("chunk", pa.int64()))]
            yield pa.RecordBatch.from_arrays([*same, *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True))], names=["video", "is_null", "chunk", "start", "cut", "first", "n"])

    return run


def _exits(batches):
    """For each entry into a chunk the place outside it that following the cuts leads to."""
    for r in _rows_of(batches):
        cuts = {x["start"]: x["cut"] for x in r["cuts"].as_py()}
        exits: dict[int, int] = {}
        for start in sorted(cuts, reverse=True):
            exits[start] = exits.get(cuts[start], cuts[start])
        entries = [x for x in r["entries"].as_py() if x in exits]
        same = [pa.array([r[c].as_py()] * len(entries), t) for c, t in (("video", pa.string()), ("is_null", pa.bool_()))]
        yield pa.RecordBatch.from_arrays([*same, pa.array(entries, pa.int64()), pa.array([exits[x] for x in entries], pa.int64())], names=["video", "is_null", "entry", "to"])


def _followed(batches):
    """The groups that begin in a chunk, from the one place where it is entered."""
    for r in _rows_of(batches):
        cuts, at, out = {x["start"]: x["cut"] for x in r["cuts"].as_py()}, r["entry"].as_py(), []
        while at in cuts:
            out.append((at, cuts[at]))
            at = cuts[at]
        same = [pa.array([r[c].as_py()] * len(out), t) for c, t in (("video", pa.string()), ("is_null", pa.bool_()), ("chunk", pa.int64()))]
        yield pa.RecordBatch.from_arrays([*same, *(pa.array([x[k] for x in out], pa.int64()) for k in range(2))], names=["video", "is_null", "chunk", "start", "cut"])


def greedy_groups(rows: DataFrame, rule: Rule, order: list[str], *, key: str = "video_id", ends: Column | None = None, chunk: int = CHUNK, bucket_s: float = BUCKET_S) -> DataFrame:
    """rows with `pos` (their number in the video) and `group_no`, from 0: greedy groups by the rule, in the order.

    The same groups as a fold over each video's sorted array, but no task has more of a video than a chunk of rows. Only
    the video's name as text, times and whether a row ends a group go through the steps; rows meet their groups at the
    end by place. A video of n rows takes log2(n / chunk) rounds of pointers.
    """
    spark, store = rows.sparkSession, _own_store(rows.sparkSession)
    name, kind = F.coalesce(F.col(key).cast("string"), F.lit("")), (F.col(key).cast("string").alias("video"), F.col(key).isNull().alias("is_null"))
    all_rows = _written(spark, numbered(rows.withColumn("_ends", F.coalesce(F.lit(False) if ends is None else ends, F.lit(False))), order, key=key, bucket_s=bucket_s), store, "rows")
    by = ["video", "is_null"]
    slim = all_rows.select(name.alias("video"), kind[1], "pos", F.col("t_start").cast("double").alias("t_start"), F.col("t_end").cast("double").alias("t_end"), "_ends")
    lists = F.array_sort(F.collect_list(F.struct("pos", "t_start", "t_end", "_ends")))
    packed = slim.groupBy(*by, F.floor(F.col("pos") / chunk).alias("chunk")).agg(lists.alias("x"))
    last = slim.groupBy(*by).agg(F.floor(F.max("pos") / chunk).alias("last_chunk"))
    chunks = packed.join(last, by).select(*by, "chunk", (F.col("chunk") == F.col("last_chunk")).alias("last"), F.col("x.t_start").alias("t_start"), F.col("x.t_end").alias("t_end"), F.col("x._ends").alias("ends"))
    chunks = _written(spark, chunks, store, "chunks")
    schema = "video string, is_null boolean, chunk long, start long, cut long, first double, n long"
    found = _written(spark, chunks.mapInArrow(_found(rule, chunk), schema), store, "cuts_0")
    steps, step = [found], 0
    while not found.where("cut IS NULL").isEmpty():  # seldom more than once: a group longer than a chunk
        step += 1
        waiting = found.where("cut IS NULL").groupBy(*by, (F.col("chunk") + 1).alias("chunk")).agg(F.collect_list(F.struct("start", "first", "n")).alias("open"))
        found = _written(spark, chunks.join(waiting, [*by, "chunk"]).mapInArrow(_continued(rule, chunk), schema), store, f"cuts_{step}")
        steps.append(found)
    cuts = steps[0].where("cut IS NOT NULL")
    for x in steps[1:]:
        cuts = cuts.unionByName(x.where("cut IS NOT NULL"))
    cuts = _written(spark, cuts.select(*by, F.floor(F.col("start") / chunk).alias("chunk"), "start", "cut"), store, "cuts")
    of_chunk = cuts.groupBy(*by, "chunk").agg(F.collect_list(F.struct("start", "cut")).alias("cuts"))
    # Where a chunk may be entered: at cuts of groups that began before it. The first is entered at 0.
    crossing = cuts.where(F.floor(F.col("cut") / chunk) > F.col("chunk")).select(*by, F.floor(F.col("cut") / chunk).alias("chunk"), F.col("cut").alias("entry")).distinct()
    first = cuts.where("start = 0").select(*by, F.lit(0).cast("long").alias("chunk"), F.lit(0).cast("long").alias("entry"))
    entries = crossing.unionByName(first).groupBy(*by, "chunk").agg(F.collect_list("entry").alias("entries"))
    links = _written(spark, of_chunk.join(entries, [*by, "chunk"]).mapInArrow(_exits, "video string, is_null boolean, entry long, to long"), store, "links_0")
    reached = _written(spark, first.select(*by, "entry"), store, "reached_0")
    jumps = links
    for n in range(1, 64):
        then = reached.join(jumps, [*by, "entry"]).select(*by, F.col("to").alias("entry")).join(links.select(*by, "entry"), [*by, "entry"], "left_semi")
        more = then.join(reached, [*by, "entry"], "left_anti").distinct()
        if more.isEmpty():
            break
        reached = _written(spark, reached.unionByName(more), store, f"reached_{n}")
        far = jumps.select(*by, "entry", F.col("to").alias("_via")).join(jumps.select(*by, F.col("entry").alias("_via"), "to"), [*by, "_via"]).select(*by, "entry", "to")
        jumps = _written(spark, far, store, f"links_{n}")
    at = reached.select(*by, F.floor(F.col("entry") / chunk).alias("chunk"), "entry")
    groups = _written(spark, of_chunk.join(at, [*by, "chunk"]).mapInArrow(_followed, "video string, is_null boolean, chunk long, start long, cut long"), store, "groups")
    # Groups are numbered in their chunks, and those of the chunks before are added.
    per_chunk = groups.groupBy(*by, "chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_chunk.select(*by, "chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    ranked = groups.withColumn("_in", F.row_number().over(Window.partitionBy(*by, "chunk").orderBy("start"))).join(offsets, [*by, "chunk"])
    numbers = ranked.select(*by, "start", "cut", (F.col("_offset") + F.col("_in") - 1).alias("group_no"))
    # A row meets its group in its chunk: a group is in every chunk that it reaches, which are few.
    spread = numbers.withColumn("_chunk", F.explode(F.sequence(F.floor(F.col("start") / chunk), F.floor((F.col("cut") - 1) / chunk))))
    lists = spread.groupBy(F.col("video").alias("_video"), F.col("is_null").alias("_is_null"), "_chunk").agg(F.array_sort(F.collect_list(F.struct("start", "group_no"))).alias("_groups"))
    own = all_rows.withColumns({"_name": name, "_no_name": F.col(key).isNull(), "_at": F.floor(F.col("pos") / chunk)})
    met = own.join(lists, (own["_name"] == lists["_video"]) & (own["_no_name"] == lists["_is_null"]) & (own["_at"] == lists["_chunk"]))
    group = F.element_at(F.filter("_groups", lambda g: g["start"] <= F.col("pos")), -1)["group_no"]
    return met.withColumn("group_no", group).select(*rows.columns, "pos", "group_no")


def spans_of(grouped: DataFrame, *, key: str = "video_id") -> DataFrame:
    """key, group_no, first_pos, n, t_start of the first row and t_end of the last one, of rows of greedy_groups()."""
    return grouped.groupBy(key, "group_no").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"), F.min_by("t_start", "pos").alias("t_start"), F.max_by("t_end", "pos").alias("t_end"))


# --- islands ------------------------------------------------------------------------------------------------------


def islands(spans: DataFrame, max_gap_s: float, *, bucket_s: float = BUCKET_S) -> DataFrame:
    """spans with `island`, the number of their run in the video: as in intervals.merge_spans(), but sorted within
    buckets of time only; the latest end and the number of runs so far are carried over one row a bucket."""
    placed = spans.withColumn("_bucket", F.floor(F.col("t_start") / bucket_s))
    ends = placed.groupBy("video_id", "_bucket").agg(F.max("t_end").alias("_end"))
    before = Window.partitionBy("video_id").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("video_id", "_bucket", F.max("_end").over(before).alias("_carried"))
    order = Window.partitionBy("video_id", "_bucket").orderBy("t_start", "unit_id")
    within = placed.join(carried, ["video_id", "_bucket"]).withColumn("_reached", F.greatest("_carried", F.max("t_end").over(order.rowsBetween(Window.unboundedPreceding, -1))))
    marked = within.withColumn("_begins", F.when(F.col("t_start") - F.col("_reached") <= max_gap_s, 0).otherwise(1))
    counts = marked.groupBy("video_id", "_bucket").agg(F.sum("_begins").alias("_n"))
    offsets = counts.select("video_id", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return marked.withColumn("_in", inside).join(offsets, ["video_id", "_bucket"]).withColumn("island", F.col("_offset") + F.col("_in")).select(*spans.columns, "island")


def merge_islands(spans: DataFrame, max_gap_s: float, *, bucket_s: float = BUCKET_S) -> DataFrame:
    """video_id, t_start, t_end, score, unit_ids: the rows of intervals.merge_spans()."""
    merged = islands(spans, max_gap_s, bucket_s=bucket_s).groupBy("video_id", "island").agg(
        F.min("t_start").alias("t_start"), F.max("t_end").alias("t_end"), F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("t_start", "unit_id"))).alias("_units")
    )
    return merged.select("video_id", "t_start", "t_end", "score", F.col("_units.unit_id").alias("unit_ids"))


# --- spans of very different lengths ------------------------------------------------------------------------------


def _ticks(a: str, b: str, tick_s: float) -> tuple[Column, Column]:
    x, y = F.floor(F.col(a) / tick_s), F.floor(F.col(b) / tick_s)
    return F.least(x, y), F.greatest(x, y)


def _shifted(x: Column, by: Column) -> Column:
    return F.call_function("shiftright", x, by)


def _covering(low: Column, high: Column, levels: int) -> Column:
    """Aligned pieces of 2^level ticks (level, no) that make up low to high: two of a level at most."""

    def of(level: Column) -> Column:
        first = _shifted(low + F.pow(F.lit(2.0), level).cast("long") - 1, level)
        until = _shifted(high + 1, level)
        inside = first < until
        return F.array(
            F.when(inside & (first % 2 != 0), F.struct(level.alias("level"), first.alias("no"))),
            F.when(inside & (until % 2 != 0), F.struct(level.alias("level"), (until - 1).alias("no"))),
        )

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of)), lambda p: p.isNotNull())


def _above(low: Column, high: Column, levels: int) -> Column:
    """Aligned pieces that low to high covers in part: what lies above the pieces that make it up."""

    def of(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level).cast("long")
        a, b = _shifted(low, level), _shifted(high, level)
        partly = lambda x: (x * size < low) | (x * size + size - 1 > high)
        return F.array(F.when(partly(a), F.struct(level.alias("level"), a.alias("no"))), F.when((a != b) & partly(b), F.struct(level.alias("level"), b.alias("no"))))

    return F.filter(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of)), lambda p: p.isNotNull())


def dyadic_pieces(spans: DataFrame, *, tick_s: float = 1.0, a: str = "t_start", b: str = "t_end", levels: int = 40, above: int | None = None) -> DataFrame:
    """spans with `level`, `no` and `own`: a row for each aligned piece that makes the span up (own), two a level at most,
    and for each piece above those, up to the level `above`. Times below 0 are pieces too."""
    low, high = _ticks(a, b, tick_s)
    pieces = F.transform(_covering(low, high, levels), lambda p: F.struct(p["level"].alias("level"), p["no"].alias("no"), F.lit(True).alias("own")))
    if above is not None:
        pieces = F.concat(pieces, F.transform(_above(low, high, above), lambda p: F.struct(p["level"].alias("level"), p["no"].alias("no"), F.lit(False).alias("own"))))
    return spans.select("*", F.inline(pieces))


def overlaps(a: DataFrame, b: DataFrame, *, tick_s: float = 1.0, levels: int = 40) -> DataFrame:
    """Pairs of spans of one video that overlap, as intervals.overlaps() gives them, for spans of any mix of lengths.

    A span is in a number of pieces that grows with the logarithm of its length, so a day among seconds is some dozens of
    rows and not a row for every bucket of the day. Two spans overlap exactly if a piece of one is a piece of the other
    or lies above one, and the pair is kept once, at the piece with the first tick of both. Pieces are dozens of rows a
    span, of which Spark's estimate knows nothing, so neither side may be broadcast: they meet by a sorted merge.
    """
    b = b.select(*(F.col(c).alias(f"b_{c}") for c in b.columns))
    most = lambda x, p, q: x.agg(F.max(F.greatest(F.abs(F.floor(F.col(q) / tick_s) - F.floor(F.col(p) / tick_s)) + 1, F.lit(1)))).collect()[0][0] or 1
    # No piece that makes up a span is longer than the span, so nothing above the longest piece of the others can meet one.
    top = [min(levels, int(most(x, p, q)).bit_length()) for x, p, q in ((a, "t_start", "t_end"), (b, "b_t_start", "b_t_end"))]
    left = dyadic_pieces(a, tick_s=tick_s, levels=top[0], above=top[1]).withColumnsRenamed({"level": "_level", "no": "_no", "own": "_own"})
    right = dyadic_pieces(b, tick_s=tick_s, a="b_t_start", b="b_t_end", levels=top[1], above=top[0]).withColumnsRenamed({"level": "_b_level", "no": "_b_no", "own": "_b_own"})
    first = F.greatest(_ticks("t_start", "t_end", tick_s)[0], _ticks("b_t_start", "b_t_end", tick_s)[0])
    meet = (F.col("video_id") == F.col("b_video_id")) & (F.col("_level") == F.col("_b_level")) & (F.col("_no") == F.col("_b_no"))
    exact = (F.col("_own") | F.col("_b_own")) & (_shifted(first, F.col("_level")) == F.col("_no")) & (F.col("b_t_start") < F.col("t_end")) & (F.col("b_t_end") > F.col("t_start"))
    return left.join(right.hint("merge"), meet & exact).drop("_level", "_no", "_own", "_b_level", "_b_no", "_b_own")
