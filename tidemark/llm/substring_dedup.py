"""Removal of passages whose word windows occur more than once in the corpus.

Two passes decide which windows repeat, and neither compares documents with each other. First each window names its
anchor, the run of ANCHOR words with the least hash in it: equal windows have equal anchors, and about one word in
fourteen starts an anchor, so few keys are exchanged. Only windows with an anchor that occurs twice can repeat; their
128-bit hashes, two independent ones of 64 bits, are exchanged in the second pass. Documents of equal words are one document for the second pass.

Suffix automata of reference shards, broadcast to all documents, compare every shard with every document; they are in
suffix_automaton.py for a reference of bounded size. README.md has the figures.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, map_arrow, slices
from tidemark.llm.exact_dedup import BUCKETS
from tidemark.llm.exchange import FLUSH, HELD, HELD_NAMES, Held, parts_for, repeated_places
from tidemark.llm.words import Words, grams, mix

ANCHOR = 10
#: An anchor that occurs more often doesn't decide where its windows go: equal windows have equal anchors, so all agree.
COMMON = 500
_PLACE_BITS, _BLOCK = 24, 1 << 22
_SLICE = 500_000


def anchors(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of the windows, word where each window's anchor starts, anchor hash by word)."""
    size = min(ANCHOR, window)
    at = words.windows(window)
    if not len(at):
        return at, at, hashes
    own_grams = grams(hashes, size)
    span, chosen = window - size + 1, []
    for first in range(0, len(at), _BLOCK):  # windows whose places fit in the low bits
        own = at[first : first + _BLOCK]
        low, high = own[0], own[-1] + span
        # The place in the low bits makes the leftmost of equal anchors the least.
        least = own_grams[low:high] >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS) | np.arange(high - low, dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[: len(least) - width], least[width:])
            width *= 2
        least = np.minimum(least[own - low], least[own - low + span - width])
        chosen.append((least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64) + low)
    return at, np.concatenate(chosen), own_grams


def _doc_of(words: Words, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(words.first, at, side="right") - 1


def _first_pass(window: int, parts: int):
    def run(batches):
        none = np.zeros(0, np.uint64)
        held = Held(parts)
        for rids, data, rows in slices(batches, _SLICE):
            words = Words(data)
            at, start, named = anchors(words, words.hashes(), window)
            starts = np.unique(start)
            if len(starts):
                held.add(rids, named[starts], none, _doc_of(words, starts), np.zeros(len(starts), np.int64), np.zeros(len(starts), bool), mix(named[starts]))
            whole = [hashlib.sha256(b" ".join((x or b"").split())).digest() for x in data]
            yield _batch(len(rids), rid=pa.array(rids, pa.binary()), id=rows.column(rows.schema.get_field_index("id")), n_words=pa.array(words.sizes, pa.int64()), sha=pa.array(whole, pa.binary()), kind_of_row=pa.array([0] * len(rids), pa.int32()))
            if held.size >= FLUSH:
                yield _packed(held)
                held = Held(parts)
        if held.size:
            yield _packed(held)

    return run


_FIRST = f"rid binary, id long, n_words long, sha binary, kind_of_row int, {HELD}"


def _batch(n: int, **columns) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in _FIRST.split(", ")]
    return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, kinds[kind])) for name, kind in fields], names=[name for name, _ in fields])


def _packed(held: Held) -> pa.RecordBatch:
    rows = held.rows()
    return _batch(len(rows), kind_of_row=pa.array([1] * len(rows), pa.int32()), **{name: rows.column(k) for k, name in enumerate(rows.schema.names)})


def _second_pass(window: int, parts: int):
    def run(batches):
        held = Held(parts)
        for rids, data, rows in slices(batches, _SLICE):
            words = Words(data)
            hashes = words.hashes()
            at, start, named = anchors(words, hashes, window)
            doc, chosen, often = _doc_of(words, at), [], []
            bounds = np.searchsorted(doc, np.arange(len(rids) + 1))
            for k, own in enumerate(rows.column(rows.schema.get_field_index("lists")).to_pylist()):
                a, b = bounds[k], bounds[k + 1]
                values, totals = (np.frombuffer(b"".join(x[c] for x in own), t) for c, t in (("values", "<u8"), ("totals", "<u4")))
                values, first = np.unique(values, return_index=True)
                place = np.minimum(np.searchsorted(values, named[start[a:b]]), max(len(values) - 1, 0))
                hit = np.flatnonzero(values[place] == named[start[a:b]]) if len(values) else np.zeros(0, np.int64)
                chosen.append(hit + a)
                often.append(totals[first][place[hit]])
            chosen, often = np.concatenate(chosen), np.concatenate(often)
            if len(chosen):
                first, own = at[chosen], doc[chosen]
                several = np.array(rows.column(rows.schema.get_field_index("several")).to_pylist(), bool)[own]
                high, low = grams(hashes, window)[first], grams(words.hashes(1), window, 1)[first]
                # An anchor is a least hash, so it is mixed anew. Windows of one anchor stay together, so that their places compress; those of a common one are dealt by their own hash.
                held.add(rids, high, low, own, first - words.first[own], several, np.where(often > COMMON, high, mix(named[start[chosen]])))
            if held.size >= FLUSH:
                yield held.rows()
                held = Held(parts)
        if held.size:
            yield held.rows()

    return run


def covered(places: np.ndarray, window: int, n: int) -> np.ndarray:
    """Which of n words a window that starts at one of the places covers."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, places, 1)
    np.add.at(edge, np.minimum(places + window, n), -1)
    return np.cumsum(edge[:-1]) > 0


def _without(window: int):
    def run(batches):
        for rids, data, rows in slices(batches, _SLICE):
            removed, shas, kept_texts = [], [], []
            for text, places in zip(data, rows.column(rows.schema.get_field_index("places")).to_pylist(), strict=True):
                words = (text or b"").split()
                gone = covered(np.frombuffer(b"".join(places), "<u4").astype(np.int64), window, len(words))
                kept = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])
                removed.append(int(gone.sum()))
                shas.append(hashlib.sha256(kept).digest())
                kept_texts.append(kept)
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.binary()), pa.array(removed, pa.int64()), pa.array(shas, pa.binary()), pa.array(kept_texts, pa.binary())], names=["rid", "removed", "kept_sha", "kept"])

    return run


def _identified(docs: DataFrame) -> DataFrame:
    """A row's key is a hash of its id and text, so rows that repeat an id stay apart. It stands in the place of doc_id."""
    text = F.col("text").cast("string").cast("binary")
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"), F.lit(":").cast("binary"), F.coalesce(text, F.lit("").cast("binary")))
    return docs.select(F.unhex(F.md5(name)).alias("doc_id"), text.alias("text"), F.col("doc_id").cast("long").alias("id"))


def dedup_substrings(docs: DataFrame, *, window: int = 50, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256; with_text adds `kept`, the words left, joined by one space.

    A word is a run of anything but space and 0x09-0x0D. It goes if a run of `window` words around it starts at another
    place too, in this document or another. A null text has no words. Rows that repeat a doc_id are documents of their
    own, so two equal rows remove each other's words. A text of any length is read whole; one longer than a slice is a step
    of its own. Windows aren't ranked, so there are no ties. An empty table gives no rows; columns but doc_id and text are
    left behind.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "substrings")
    rows = _identified(docs)
    words_about = rows.select(F.sum(F.length("text"))).first()[0] or 0
    parts = parts_for(words_about // 60)
    first = scratch.table(map_arrow(rows, _first_pass(window, parts), _FIRST), "first")
    base = first.where("kind_of_row = 0").select("rid", F.col("id").alias("doc_id"), "n_words", "sha")
    found = repeated_places(first.where("kind_of_row = 1").select(*HELD_NAMES), ["values", "totals"], 16)
    repeated_anchors = scratch.table(found.groupBy("rid").agg(F.flatten(F.collect_list("lists")).alias("lists")), "anchors")
    classes = scratch.table(base.where(F.col("n_words") >= window).groupBy("sha").agg(F.count(F.lit(1)).alias("n"), F.min("rid").alias("rep")).where("n > 1"), "classes")

    marked = base.join(classes, "sha", "left")
    wanted = marked.where("n IS NULL OR rid = rep").groupBy("rid").agg(F.max(F.col("n").isNotNull()).alias("several")).join(repeated_anchors, "rid")
    wanted = scratch.table(wanted.select(F.col("rid").alias("doc_id"), "several", "lists"), "wanted")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    near = rows.select("doc_id", "text").join(F.broadcast(wanted.select(bucket.alias("bucket")).distinct()), bucket == F.col("bucket"), "left_semi")  # at most BUCKETS rows
    held = scratch.table(near.join(wanted, "doc_id").select("doc_id", "text", "several", "lists").dropDuplicates(["doc_id"]), "held")

    keys = scratch.table(map_arrow(held, _second_pass(window, parts), HELD), "keys")
    places = repeated_places(keys, ["places"], 16).select(F.col("rid").alias("doc_id"), F.col("lists.places").alias("places"))
    edits = map_arrow(held.where(~F.col("several")).select("doc_id", "text").join(places, "doc_id"), _without(window), "rid binary, removed long, kept_sha binary, kept binary")
    if not with_text:
        edits = edits.drop("kept")
    gone = F.col("n").isNotNull()
    nothing = F.unhex(F.sha2(F.lit("").cast("binary"), 256))
    sha = F.when(gone, nothing).otherwise(F.coalesce("kept_sha", "sha"))
    out = marked.join(edits, "rid", "left")
    columns = ["doc_id", "n_words", F.when(gone, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).cast("long").alias("n_removed"), F.lower(F.hex(sha)).alias("kept_sha256")]
    if not with_text:
        return out.select(*columns)
    whole = rows.select(F.col("doc_id").alias("rid"), F.trim(F.regexp_replace(F.col("text").cast("string"), "[ \\x09-\\x0D]+", " ")).alias("whole")).dropDuplicates(["rid"])
    kept = F.when(gone, "").otherwise(F.coalesce(F.col("kept").cast("string"), "whole", F.lit("")))
    return out.join(whole, "rid").select(*columns, kept.alias("kept"))
