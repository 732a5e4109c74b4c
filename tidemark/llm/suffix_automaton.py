"""Suffix automata of reference shards, broadcast one after the other, through which documents are streamed.

For a reference of bounded size, such as a licence collection. Each document word moves through the automaton; the
length of the match that ends there is its matching statistic, and spans of `window` words or more that the reference
has are removed. With n words of documents and m of reference in shards of s words, the work is n * m / s steps, so a
corpus that is its own reference is done by substring_dedup instead.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, map_arrow, slices, texts
from tidemark.llm.substring_dedup import covered

#: Words of one shard's automaton, and bytes of reference text that the driver holds at once.
SHARD_WORDS, BLOCK_BYTES = 50_000, 4_000_000


class SuffixAutomaton:
    """States by number: transitions, suffix link, length of the longest run of words that ends there."""

    def __init__(self):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]

    def add_text(self, words: list[bytes]) -> None:
        last = 0
        for w in words:
            last = self._extend(last, w)

    def _new(self, length: int, link: int, moves: dict[bytes, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, w: bytes) -> int:
        """The state for what p reads with w, as long as p and no longer."""
        q = self.next[p][w]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: bytes) -> int:
        if w in self.next[last]:  # another text has come this way
            return self._split(last, w)
        state = self._new(self.length[last] + 1, 0, {})
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            self.link[state] = self._split(p, w)
        return state

    def matches(self, words: list[bytes]) -> list[int]:
        """At each word the length of the longest run that ends there and occurs in the reference."""
        out, state, n = [], 0, 0
        moves, link, length = self.next, self.link, self.length
        for w in words:
            while (to := moves[state].get(w)) is None and state:
                state = link[state]
                n = length[state]
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            out.append(n)
        return out


def shards(reference: list[bytes], words: int = SHARD_WORDS) -> list[SuffixAutomaton]:
    """Automata of at most about `words` words each; a longer text has one of its own."""
    out, held = [], words + 1
    for text in reference:
        own = text.split()
        if held + len(own) > words:
            out.append(SuffixAutomaton())
            held = 0
        out[-1].add_text(own)
        held += len(own)
    return out


def _found(automaton, window: int):
    def run(batches):
        for ids, data, rows in slices(batches):
            held = rows.column(rows.schema.get_field_index("starts")).to_pylist()
            for k, text in enumerate(data):
                ends = np.flatnonzero(np.array(automaton.value.matches((text or b"").split()), np.int64) >= window)
                held[k] = held[k] + (ends - window + 1).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary()), pa.array(held, pa.list_(pa.int64()))], names=["doc_id", "text", "starts"])

    return run


def _removed(window: int):
    def run(batches):
        for ids, data, rows in slices(batches):
            out = []
            for doc_id, text, starts in zip(ids, data, rows.column(rows.schema.get_field_index("starts")).to_pylist(), strict=True):
                words = (text or b"").split()
                gone = covered(np.array(starts, np.int64), window, len(words))
                kept = b" ".join([w for w, x in zip(words, gone.tolist(), strict=True) if not x])
                out.append((doc_id, len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "replace")))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def remove_reference(docs: DataFrame, reference: DataFrame, *, window: int = 50) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, kept: without runs of `window` words of the reference's `text`.

    Null texts have no words; an empty reference removes nothing. The reference is read in blocks of bounded size.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix_automata")
    rows = reference.where("text IS NOT NULL").select(F.col("text").cast("string").cast("binary").alias("text")).distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    rows = rows.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(max(blocks, 1))))
    out = texts(docs).withColumn("starts", F.array().cast("array<bigint>"))
    for block in range(blocks):
        held = [bytes(r["text"]) for r in rows.where(F.col("block") == block).select("text").collect()]
        for automaton in shards(held):
            out = map_arrow(out, _found(spark.sparkContext.broadcast(automaton), window), "doc_id long, text binary, starts array<bigint>")
        out = scratch.table(out, f"block_{block}")
    return map_arrow(out, _removed(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
