"""Similarity join of documents by the Jaccard measure of their word shingles, with adaptive multi-match prefixes.

All documents order their shingles alike: by a sketch of the shingles' frequencies over the whole corpus, rarest first,
then by hash. If two sets are similar, their prefixes for `l` matches share at least `l` shingles. Each document takes
the `l` of least estimated cost. The first prefixes drop documents that share too few shingles with all others together.
The second ones find candidates: two documents are compared only if their prefixes share as many shingles as the lesser
of what the two ask for. Texts of equal words are one class with one representative.

Candidates are compared in rounds, so a group of thousands of similar documents is never expanded to all its pairs: a
round pairs the documents of each shingle with one centre, asks their prefixes for the matches, verifies the pairs that
have them and joins what is linked to components. The last round asks all documents that lists still hold together and
that lie in several components for the matches, in blocks of prefixes, and compares those that candidates connect, in
blocks of texts, so no link that could join two components is missed.

Hashes only find candidates: a link is found by comparing words.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ROW, Scratch, by_row, further_rows, map_arrow, own_columns, slices, sum_vectors, texts, with_rows
from tidemark.llm.components import components
from tidemark.llm.exchange import FLUSH, HELD, Held, parts_for, repeated_counts, repeated_places
from tidemark.llm.exact_dedup import BUCKETS
from tidemark.llm.words import Words, grams

#: Counters of the frequency sketch: its size doesn't depend on the corpus.
SKETCH = 1 << 19
#: Matches that a prefix may ask for in percent of the set, and what verifying a pair costs in list entries read.
MATCH_PERCENTS, VERIFY_COST = (5, 10, 20, 35), 30
#: What the first prefix asks for, in percent of the set.
FIRST_PERCENT = 8
#: Documents that one verification task compares with a centre at once.
CHUNK = 200
#: Rounds with one centre for each shingle before the rest is compared in full, in blocks of so many documents. Each round
#: costs the driver the memory of some 15 jobs.
ROUNDS, TILE = 1, 150
#: Shingles of a block at most, about, unless one document has more.
TILE_SHINGLES = 400_000


def shingle_sets(data: list[bytes | None], size: int) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles; a shorter text is one shingle, one without words none."""
    words = Words(data, lower=True)
    at = words.windows(size)
    whole = grams(words.hashes(), size)[at]
    bounds = np.searchsorted(at, words.first)
    for k in range(len(data)):
        if 0 < words.sizes[k] < size:
            yield np.array([int.from_bytes(_name(data[k])[:8], "little")], np.uint64)
        else:
            yield np.unique(whole[bounds[k] : bounds[k + 1]])


def _name(text: bytes | None) -> bytes:
    """By this name the exchange knows a text: texts of equal words have one."""
    return hashlib.blake2b(b" ".join((text or b"").lower().split()), digest_size=16).digest()


def exact_sets(data: list[bytes | None], size: int) -> list[np.ndarray]:
    """Sorted distinct numbers of each text's shingles; two have one number if their words are equal, byte for byte."""
    known: defaultdict[bytes, int] = defaultdict(count().__next__)
    short: defaultdict[bytes, int] = defaultdict(count().__next__)
    split = [(x or b"").lower().split() for x in data]
    own = [np.fromiter(map(known.__getitem__, w), np.int64, len(w)) if len(w) >= size else np.zeros(0, np.int64) for w in split]
    sizes = np.array([len(x) for x in own], np.int64)
    now, width = np.concatenate([np.zeros(0, np.int64), *own]), 1
    while width < size and len(now) > width:  # numbers of runs twice as long, or as long as is wanted
        step = min(width, size - width)
        pair = now[: len(now) - step] * (int(now.max(initial=0)) + 1) + now[step:]
        now, width = np.unique(pair, return_inverse=True)[1], width + step
    first = np.cumsum(sizes) - sizes
    return [np.array([-1 - short[b" ".join(w)]]) if 0 < len(w) < size else np.unique(now[a : a + n - size + 1]) if n else np.zeros(0, np.int64) for w, a, n in zip(split, first.tolist(), sizes.tolist(), strict=True)]


def needed_overlap(n: np.ndarray | int, percent: int):
    """Shingles that a set of n shares at least with any similar set."""
    return -(-percent * n // 100)


def _profiles(size: int):
    def run(batches):
        sketch = np.zeros(SKETCH, np.int64)
        for ids, data, _ in slices(batches, 1_000_000):
            sizes, digests = [], []
            for text, own in zip(data, shingle_sets(data, size), strict=True):
                sizes.append(len(own))
                digests.append(_name(text) if len(own) else None)
                sketch[(own & np.uint64(SKETCH - 1)).astype(np.int64)] += 1  # shingles of one document that share a counter count once
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(len(ids), pa.binary()), pa.array([0] * len(ids), pa.int32())], names=["doc_id", "n", "digest", "sketch", "kind"])
        if sketch.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([sketch.tobytes()], pa.binary()), pa.array([1], pa.int32())], names=["doc_id", "n", "digest", "sketch", "kind"])

    return run


def first_matches(n, percent: int):
    """Matches that the first prefix of a set of n asks for."""
    return np.maximum(1, np.minimum(needed_overlap(n, percent), n * FIRST_PERCENT // 100))


def prefix(own: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first prefix of a set, in the order of the sketch."""
    own_counts = counts[(own & np.uint64(SKETCH - 1)).astype(np.int64)]
    order = np.lexsort((own, own_counts))
    n = len(own)
    return own[order[: n - needed_overlap(n, percent) + int(first_matches(n, percent))]]


def _prefixes(sketch, size: int, percent: int, parts: int):
    """Prefixes in the sketch's order, or whole sets without a sketch."""

    def run(batches):
        none = np.zeros(0, np.uint64)
        held, seen = Held(parts), set()
        for ids, data, _ in slices(batches, 1_000_000):
            names, tokens = [], [none]
            for doc_id, text, own in zip(ids, data, shingle_sets(data, size), strict=True):
                if len(own) and doc_id is not None and (name := _name(text)) not in seen:  # of equal texts one
                    seen.add(name)
                    names.append(name)
                    tokens.append(prefix(own, sketch.value, percent) if sketch else own)
            every = np.concatenate(tokens)
            doc = np.repeat(np.arange(len(names)), [len(x) for x in tokens[1:]])
            held.add(names, every, none, doc, np.zeros(len(every), np.int64), np.zeros(len(every), bool))
            if held.size >= FLUSH:
                yield held.rows()
                held, seen = Held(parts), set()
        if held.size:
            yield held.rows()

    return run


def exact_prefix(values: np.ndarray, totals: np.ndarray, n: int, percent: int) -> tuple[np.ndarray, int]:
    """The shared shingles in the prefix of a set of n, ordered by how many sets hold them, and the matches it asks for.

    values and totals are those of the shared shingles: the others are rarer and come first.
    """
    order = np.lexsort((values, totals))
    overlap, alone = needed_overlap(n, percent), n - len(values)
    others = np.concatenate([[0], np.cumsum(totals[order].astype(np.int64) - 1)])
    choices = sorted({max(1, min(overlap, n * x // 100)) for x in (0, *MATCH_PERCENTS)})
    lengths = [min(max(n - overlap + k - alone, 0), len(values)) for k in choices]
    best = int(np.argmin([others[m] * (1 + VERIFY_COST / k) + m for k, m in zip(choices, lengths, strict=True)]))
    return values[order[: lengths[best]]], choices[best]


def _exact(percent: int):
    def run(batches):
        for batch in batches:
            out = []
            for doc_id, own, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                values, totals = (np.frombuffer(b"".join(x[c] for x in own), t) for c, t in (("values", "<u8"), ("totals", "<u4")))
                chosen, matches = exact_prefix(values, totals, n, percent)
                if len(chosen):
                    out.append((doc_id, n, matches, chosen.view(np.int64)))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 4, types, strict=True)], names=["doc_id", "n", "matches", "tokens"])

    return run


def _banded(prefixes: DataFrame, percent: int) -> DataFrame:
    """Each shingle of a prefix in two lists, by size: similar sets lie in one band of sizes or in two that are next."""
    width = -math.log(percent / 100) * 1.000001 if percent < 100 else 1e-9
    band = F.floor(F.log(F.col("n")) / width)
    both = prefixes.withColumn("band", F.explode(F.array(band, band + 1)))
    return both.select("doc_id", "band", F.explode("tokens").alias("token")).select(F.xxhash64("token", "band").alias("token"), "doc_id")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    union = len(np.union1d(a, b))
    return 100 * (len(a) + len(b) - union) >= percent * union


def _verified(size: int, percent: int):
    def run(group: pa.Table) -> pa.Table:
        ids, centres = group.column("doc_id").to_pylist(), group.column("centre").to_pylist()
        centre, base, pairs = centres[0], [], {}
        sets = exact_sets(group.column("text").to_pylist(), size)
        base = [own for doc_id, own in zip(ids, sets, strict=True) if doc_id == centre]
        for doc_id, own in zip(ids, sets, strict=True):
            if doc_id != centre and any(_similar(own, x, percent) for x in base):
                pairs[doc_id] = None
        pairs = list(pairs)
        return pa.table([pa.array([centre] * len(pairs), pa.int64()), pa.array(pairs, pa.int64())], names=["u", "v"])

    return run


def _matched(group: pa.Table) -> pa.Table:
    """The pairs with the centre whose prefixes share as many shingles as the lesser of what the two ask for."""
    ids, centres, matches = (group.column(c).to_pylist() for c in ("doc_id", "centre", "matches"))
    sets = [np.array(x, np.int64) for x in group.column("tokens").to_pylist()]
    centre = centres[0]
    own = ids.index(centre)
    pairs = [i for i, x, m in zip(ids, sets, matches, strict=True) if i != centre and len(np.intersect1d(x, sets[own], assume_unique=True)) >= min(m, matches[own])]
    return pa.table([pa.array([centre] * len(pairs), pa.int64()), pa.array(pairs, pa.int64())], names=["u", "v"])


def _by_centre(pairs: DataFrame, rows: DataFrame, scratch: Scratch, name: str, found) -> DataFrame:
    """The pairs (u, v) that `found` keeps. Each v goes with its row to a chunk of u; every chunk gets the row of u."""
    chunks = pairs.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    members = pairs.join(chunks, "u").select(F.col("u").alias("centre"), F.pmod(F.xxhash64("v"), F.col("chunks")).cast("int").alias("chunk"), F.col("v").alias("doc_id"))
    centres = chunks.select(F.col("u").alias("centre"), F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.col("u").alias("doc_id"))
    every = members.unionByName(centres).join(rows, "doc_id")
    return scratch.table(every.groupBy("centre", "chunk").applyInArrow(found, "u long, v long"), name)


def _links(pairs: DataFrame, prefixes: DataFrame, held: DataFrame, scratch: Scratch, name: str, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) that are similar: those whose prefixes have the matches are compared by their words."""
    matched = _by_centre(pairs, prefixes.select("doc_id", "matches", "tokens"), scratch, f"{name}_matched", _matched)
    return _by_centre(matched, held.select("doc_id", "text"), scratch, f"{name}_links", _verified(size, percent))


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two sets share."""
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    counts = np.bincount(column, minlength=len(values))
    place = np.cumsum(counts > 1) - 1  # members of one set only don't matter
    keep = counts[column] > 1
    row, column = row[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    bounds = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + 2048, 2048))
    for k, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        block = np.zeros((len(sets), 2048), np.float32)
        block[row[a:b], column[a:b] - 2048 * k] = 1
        out += block @ block.T
    np.fill_diagonal(out, [len(x) for x in sets])
    return out.astype(np.int64)


def _forest(pairs: list[tuple[int, int]], label: list[int], ids: list[int]) -> pa.Table:
    """Of the pairs of places those that join two labels that are still apart."""
    root = {c: c for c in label}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    links = []
    for a, b in pairs:
        x, y = find(label[a]), find(label[b])
        if x != y:  # one link for two labels is enough
            root[max(x, y)] = min(x, y)
            links.append((ids[a], ids[b]))
    u, v = zip(*links, strict=True) if links else ((), ())
    return pa.table([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _compared(size: int, percent: int):
    def run(tile: pa.Table) -> pa.Table:
        ids, component, text = (tile.column(c).to_pylist() for c in ("doc_id", "component", "text"))
        sets = exact_sets(text, size)
        shared, n = _overlaps(sets), np.array([len(x) for x in sets])
        similar = 100 * shared >= percent * (n[:, None] + n[None, :] - shared)
        return _forest(np.argwhere(np.triu(similar, 1)).tolist(), component, ids)

    return run


def _candidates(tile: pa.Table) -> pa.Table:
    """Pairs of different components whose prefixes have the matches, as many as connect all the documents of such pairs."""
    ids, component, matches = (tile.column(c).to_pylist() for c in ("doc_id", "component", "matches"))
    shared, least = _overlaps([np.array(x, np.int64) for x in tile.column("tokens").to_pylist()]), np.array(matches)
    apart = np.array(component)[:, None] != np.array(component)[None, :]
    return _forest(np.argwhere(np.triu(apart & (shared >= np.minimum(least[:, None], least[None, :])), 1)).tolist(), list(range(len(ids))), ids)


def _in_tiles(nodes: DataFrame, families: DataFrame, rows: DataFrame, scratch: Scratch, name: str, found) -> DataFrame:
    """What `found` says of the documents of each family, those that candidates hold together, and their rows.

    A family is cut into blocks of about TILE documents, or of TILE_SHINGLES shingles: those of its largest component
    (below zero) and the others. Each two blocks meet in one task, but for two of the largest component. So a document
    travels once for each block, not once for each partner, and copies that are linked already aren't compared with each
    other.
    """
    grouped = nodes.join(families.select(F.col("node").alias("doc_id"), F.col("component").alias("family")), "doc_id")
    sizes = grouped.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n").alias("n"))
    largest = sizes.groupBy("family").agg(
        F.max_by("component", "n_docs").alias("largest"), F.max_by(F.struct("n_docs", "n"), "n_docs").alias("most"), F.sum("n_docs").alias("n_docs"), F.sum("n").alias("n")
    )

    def blocks(n_docs: Column, n: Column) -> Column:
        return F.ceil(F.greatest(n_docs / TILE, n / TILE_SHINGLES)).cast("int")

    main, others = blocks(F.col("most.n_docs"), F.col("most.n")), blocks(F.col("n_docs") - F.col("most.n_docs"), F.col("n") - F.col("most.n"))
    placed = grouped.join(largest.select("family", "largest", main.alias("main"), others.alias("others")).where("others > 0"), "family")
    inside = F.col("component") == F.col("largest")
    block = F.when(inside, -1 - F.pmod(F.xxhash64("doc_id"), F.col("main"))).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("others"))).cast("int")
    partners = F.sequence(F.when(inside, 0).otherwise(-F.col("main")), F.col("others") - 1)
    tiles = placed.withColumn("block", block).withColumn("other", F.explode(partners))
    tiles = tiles.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "doc_id", "component")
    return scratch.table(tiles.join(rows, "doc_id").groupBy("family", "i", "j").applyInArrow(found, "u long, v long"), name)


def _rest(met: DataFrame, prefixes: DataFrame, held: DataFrame, scratch: Scratch, size: int, percent: int) -> DataFrame:
    """Links between components among all documents that lists hold together, first by their prefixes, then by their words."""
    nodes = scratch.table(met.select("doc_id", "component").distinct().join(prefixes.select("doc_id", "n"), "doc_id"), "rest_nodes")
    listed = components(met.select(F.col("centre_doc_id").alias("u"), F.col("doc_id").alias("v")), scratch, "listed")
    candidates = _in_tiles(nodes, listed, prefixes.select("doc_id", "matches", "tokens"), scratch, "rest_candidates", _candidates)
    return _in_tiles(nodes, components(candidates, scratch, "families"), held.select("doc_id", "text"), scratch, "rest_links", _compared(size, percent))


def jaccard_components(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Texts are lower-cased (A-Z) and cut at white space; documents link when 100 * |intersection| >= percent * |union| of
    their distinct `size`-word shingles. component_id is the smallest doc_id reachable by links. A text that is null or
    without words has no shingles and stands alone. A row with a null doc_id links with nothing: its component_id is
    null. Rows that repeat a doc_id each get a row; they count as one document that has all of their sets. Of a text of any
    length all shingles count; one task holds at most a block of texts and its own longest ones. Ties are of no account:
    ids are only compared. An empty table gives no rows; other columns than doc_id and text are left behind.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = scratch.table(map_arrow(texts(docs), _profiles(size), "doc_id long, n long, digest binary, sketch binary, kind int"), "profiles")
    profiles = rows.where("kind = 0").select("doc_id", "n", "digest")
    counts = sum_vectors(rows.where("kind = 1").select("sketch"), SKETCH, scratch, "sketch")
    total = int(counts.sum())
    # Written, so that the join below shuffles both sides and a large class can be split.
    classes = scratch.table(profiles.where("n > 0 AND doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n").alias("n")), "classes")
    names = profiles.join(classes.select("digest", "rep"), "digest", "left").select("doc_id", "n", "rep")
    several = names.where("rep IS NOT NULL").groupBy("doc_id").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low <> high")
    same = names.join(several, "doc_id").select(F.col("low").alias("u"), F.col("rep").alias("v"))  # sets of one document

    # First prefixes of all documents, in the order of the sketch. Who shares too few of them has no partner.
    sketch = spark.sparkContext.broadcast(counts)
    firsts = scratch.table(map_arrow(texts(docs), _prefixes(sketch, size, percent, parts_for(total * (100 - percent + FIRST_PERCENT) // 100)), HELD), "prefixes")
    # Copies of one set that different tasks meet have one name; the least doc_id stands for all.
    shared = repeated_counts(firsts, 16).withColumnRenamed("rid", "digest").groupBy("digest").agg(F.max("n_repeated").alias("n_repeated")).join(classes, "digest")
    smaller = F.ceil(F.col("n") * percent / 100)  # shingles of the smallest similar set, which asks for least: see first_matches
    least = F.greatest(F.lit(1), F.least(F.ceil(smaller * percent / 100), F.floor(smaller * FIRST_PERCENT / 100)))
    involved = scratch.table(shared.where(F.col("n_repeated") >= least).groupBy(F.col("rep").alias("doc_id")).agg(F.sum("n").alias("n")), "involved")
    scratch.drop("prefixes")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    near = texts(docs).join(F.broadcast(involved.select(bucket.alias("bucket")).distinct()), bucket == F.col("bucket"), "left_semi")  # at most BUCKETS rows
    held = scratch.table(near.join(involved, "doc_id", "left_semi"), "held")
    # Then, of the documents that are left, prefixes in the order of exact frequencies among them.
    shingles = involved.agg(F.sum("n")).first()[0] or 0
    whole = scratch.table(map_arrow(held, _prefixes(None, size, percent, parts_for(shingles)), HELD), "whole")
    found = repeated_places(whole, ["values", "totals"], 16).withColumnRenamed("rid", "digest").dropDuplicates(["digest"])
    found = found.join(classes, "digest").select(F.col("rep").alias("doc_id"), "lists", "n")
    prefixes = scratch.table(map_arrow(found, _exact(percent), "doc_id long, n long, matches long, tokens array<bigint>"), "exact_prefixes")
    lists = scratch.table(_banded(prefixes, percent), "lists")
    scratch.drop("whole")

    labels = spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("component")) if same.isEmpty() else components(same, scratch, "components_start")
    for turn in range(ROUNDS + 1):
        # Lists whose documents lie in one component have nothing left.
        at = lists.join(labels, F.col("doc_id") == F.col("node"), "left").select("token", "doc_id", F.coalesce("component", "doc_id").alias("component")) if turn else lists.withColumn("component", F.col("doc_id"))
        by = F.xxhash64("doc_id", F.lit(turn)) if turn else F.col("doc_id")  # another centre in each round
        centres = at.groupBy("token").agg(*(F.min_by(c, by).alias(f"centre_{c}") for c in ("doc_id", "component")), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").drop("low", "high")
        met = scratch.table(at.join(centres, "token").select("token", "doc_id", "component", "centre_doc_id", "centre_component"), f"met_{turn}")
        if met.isEmpty():
            break
        lists = met.select("token", "doc_id")
        if turn < ROUNDS:
            shared = met.where("component <> centre_component").groupBy(F.col("centre_doc_id").alias("u"), F.col("doc_id").alias("v")).agg(F.count(F.lit(1)).alias("shared"))
            pairs = shared.groupBy("v").agg(F.max_by("u", "shared").alias("u"))  # the centre that a document shares most with
            links = _links(pairs, prefixes, held, scratch, f"round_{turn}", size, percent)
        else:
            links = _rest(met, prefixes, held, scratch, size, percent)
        if links.isEmpty():
            continue
        so_far = labels.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))
        labels = components(so_far.unionByName(links), scratch, f"components_{turn}")
    final = names.join(labels, names["rep"] == labels["node"], "left")
    return final.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id"))


def one_of_each(docs: DataFrame, *, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component of rows: that of the smallest doc_id, one with a null id only where all are null.

    Here rows that repeat a doc_id or have none link by their own texts like any other.
    """
    scratch = Scratch(docs.sparkSession, "one_of_each")
    rows, unique = with_rows(docs, scratch)
    found = jaccard_components(by_row(rows), size=size, percent=percent)
    if unique:
        gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(ROW))
    else:
        gone = further_rows(found.select(F.col("doc_id").alias(ROW), F.col("component_id").alias("group")), rows, scratch)
    return rows.join(gone, ROW, "left_anti").select(*own_columns(docs))
