"""Alignment of two tokenizers' ids over the same texts, each distinct segment of the corpus once.

A text with a space before it is cut before runs of white space, where neither tokenizer can join what the cut parts: the
first (byte-level BPE) because its pattern lets a piece hold white space before other characters only, the second
(SentencePiece BPE) because no piece of its vocabulary has the run's first character after another one. Which characters
may be cut before is read from the vocabulary, see starters(). Merges inside a segment then are those in the whole text,
so ids, groups and links of a document are those of its segments one after the other.

Documents are taken in slices. A slice's distinct segments go, packed in a row for each part of the segments' hashes, to
the task of that part, which tokenises and aligns each once and answers every slice in packed rows; the slice puts its
documents together from the answers. Counts of id pairs travel the same way: a slice says in how many of its documents
each pair is linked, the task of the pair's first id adds up, knows the highest, and answers. No row stands for an
occurrence, and no part gets a segment or pair more than once from a slice, however common it is.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, map_arrow, partitions_for, slices, texts, trim, worker_caches
from tidemark.llm.tokens import distinct, spelt_bytes
from tidemark.llm.words import span_hashes

CACHE = "aligners"
#: Bytes of texts in a slice, or one longer text.
SLICE = 6_500_000
#: Parts of the segments' hashes and of the first ids. One task holds the distinct segments, or pairs, of a part, so their
#: number doubles with each doubling of the texts beyond so many bytes.
PARTS, PARTS_BYTES = 512, 16_000_000_000
#: Rounds in which slices are put together, so that only so great a part of the answers moves at a time.
ROUNDS = 4
_WHITE = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20)
_CONTINUES = np.array([0x80 <= c <= 0xBF for c in range(256)])
_VISIBLE = np.array([0x21 <= c <= 0x7E for c in range(256)])
#: First bytes of characters of two and three bytes that aren't white space for certain.
_TWO, _THREE = np.array([0xC3 <= c <= 0xDF for c in range(256)]), np.array([0xE4 <= c <= 0xEF for c in range(256)])
SPACE = "▁"  # as SentencePiece writes it


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


class Pair:
    """Both tokenizers, and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_path)
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, k in vocabulary.items():
            self.a_bytes[k] = spelt_bytes(piece)
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(SPACE, " ").encode() for k, p in ((k, self.b.id_to_piece(k)) for k in range(self.b.vocab_size()))]
        self.b_space = self.b.piece_to_id(SPACE)
        self.small = max(len(self.a_bytes), len(self.b_bytes)) <= 1 << 16

    def ids(self, segments: list[bytes]) -> Iterator[tuple[list[int], list[int]]]:
        """The ids of each segment by both; a segment begins with white space."""
        whole = [x.decode() for x in segments]
        second = self.b.encode([x.removeprefix(" ") for x in whole], num_threads=1)  # it puts a space before a text
        for x, a, b in zip(whole, self.a.encode_batch(whole, add_special_tokens=False), second, strict=True):
            if x == " ":
                b = [self.b_space]  # of nothing it makes nothing
            elif x[0] != " ":
                b = b[1:] if b[:1] == [self.b_space] else []
            yield a.ids, b


def starters(a_path: str, b_path: str) -> bytes:
    """White space of one byte before which a text may be cut after any other character: no piece of the second
    vocabulary has it there, and the first tokenizer cuts by its pattern. Other than a space, none may follow one either,
    as the second tokenizer puts one before each segment."""
    from sentencepiece import SentencePieceProcessor

    with open(a_path, encoding="utf-8") as file:
        before = json.load(file)["pre_tokenizer"] or {}
    if before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
        return b""
    b = SentencePieceProcessor(model_file=b_path)
    if b.encode("a", out_type=str)[0][:1] != SPACE:
        return b""
    joined = {(x, y) for k in range(b.vocab_size()) if not (b.is_byte(k) or b.is_control(k) or b.is_unknown(k)) for p in [b.id_to_piece(k)] for x, y in zip(p, p[1:], strict=False)}
    own = lambda w: SPACE if w == " " else w
    return bytes(c for c in _WHITE if not any(y == own(chr(c)) and not (x == SPACE == y) for x, y in joined))


def cut(data: list[bytes], before: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The texts, each with a space before it, joined; where segments start and end; and how many each text has."""
    joined = b"".join(b" " + x for x in data)
    if not joined:
        return joined, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.array([len(x) + 1 for x in data])
    first = np.cumsum(sizes) - sizes
    x = np.frombuffer(joined, np.uint8)
    may = np.isin(x, np.frombuffer(before, np.uint8))
    at = np.flatnonzero(may)
    at = at[at > 3]
    p, q, r, s = (x[at - k] for k in (1, 2, 3, 4))
    solid = _VISIBLE[p] | (_CONTINUES[p] & (_TWO[q] | (_CONTINUES[q] & (_THREE[r] | (_CONTINUES[r] & (s >= 0xF0))))))
    starts = np.union1d(first, at[solid])
    return joined, starts, np.append(starts[1:], len(joined)), np.diff(np.searchsorted(starts, np.append(first, len(joined))))


def links(a: list[int], b: list[int], a_bytes: list[bytes], b_bytes: list[bytes]) -> tuple[str, int, list[tuple[int, int]]]:
    """The groups as text, how many, and all pairs of ids whose bytes overlap."""
    if len(a) == 1 or len(b) == 1:
        return f"{','.join(map(str, a))}|{','.join(map(str, b))}", 1, [(x, y) for x in a for y in b]
    groups, pairs, i, j, first_a, first_b = [], [], 0, 0, 0, 0
    end_a, end_b = len(a_bytes[a[0]]), len(b_bytes[b[0]])
    while True:
        pairs.append((a[i], b[j]))
        both = end_a == end_b
        if end_a <= end_b:
            i += 1
        if both or end_b < end_a:
            j += 1
        if both:
            groups.append(f"{','.join(map(str, a[first_a:i]))}|{','.join(map(str, b[first_b:j]))}")
            first_a, first_b = i, j
            if i == len(a):
                return ";".join(groups), len(groups), pairs
            end_a, end_b = end_a + len(a_bytes[a[i]]), end_b + len(b_bytes[b[j]])
        elif end_a < end_b:
            end_a += len(a_bytes[a[i]])
        else:
            end_b += len(b_bytes[b[j]])


def aligner(a_path: str, b_path: str) -> Pair:
    """One for each worker process."""
    held = worker_caches.setdefault(CACHE, {})
    if (a_path, b_path) not in held:
        held[a_path, b_path] = Pair(a_path, b_path)
    return held[a_path, b_path]


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.large_binary(), "string": pa.string()}
    names = [x.split() for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, names, strict=True)], names=[n for n, _ in names])


def _split(data: bytes, sizes: np.ndarray) -> list[bytes]:
    ends = np.cumsum(sizes).tolist()
    return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]


#: A slice's documents (part -1: names, nulls, counts of segments, codes of segments), or its distinct segments of a part
#: (from the code `first` on: joined bytes, sizes). `round` is that of the slice, or -1 for segments.
CUT = "round int, slice long, part int, first int, names binary, nulls binary, counts binary, codes binary, data binary, sizes binary"
#: For each segment its numbers (0: no alignment, else 1; ids of both, groups), its groups' text, and its pairs.
ANSWERS = "round int, slice long, first int, numbers binary, groups binary, groups_sizes binary, pairs binary, pairs_sizes binary"
#: A slice's documents put together (part -1), or its distinct pairs of a part, in how many of its documents each is.
TALLIES = "slice long, part int, first int, names binary, nulls binary, numbers binary, digests binary, groups binary, groups_sizes binary, counts binary, codes binary, often binary, pairs binary"
TOTALS = "part int, pairs binary, totals binary, best binary"
REPLIES = "slice long, first int, totals binary, best binary"
DOCUMENTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def parts_for(size: int) -> int:
    return PARTS << max(0, -(-size // PARTS_BYTES) - 1).bit_length()


def _cut_rows(before: bytes, parts: int):
    def run(batches):
        for names, data, _ in slices(batches, most=SLICE, keep=CACHE):
            own = [_utf8(x) for x in data]
            joined, starts, ends, counts = cut([x for x in own if x], before)
            number = uuid.uuid4().int >> 65
            all_counts = np.zeros(len(own), "<u4")
            all_counts[[k for k, x in enumerate(own) if x]] = counts
            out, codes = [], np.zeros(0, np.int64)
            if len(starts):
                first, codes = distinct(joined, starts, ends)
                part = (span_hashes(joined, starts[first], ends[first]) >> np.uint64(40)).astype(np.int64) % parts
                order = np.argsort(part, kind="stable")
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order))
                codes = rank[codes]
                chosen = first[order]
                bounds = np.searchsorted(part[order], np.arange(parts + 1)).tolist()
                for k, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    if y > x:
                        a, b = starts[chosen[x:y]], ends[chosen[x:y]]
                        out.append((-1, number, k, x, None, None, None, None, b"".join(joined[i:j] for i, j in zip(a.tolist(), b.tolist(), strict=True)), (b - a).astype("<u4").tobytes()))
            ids = np.array([x or 0 for x in names], "<i8").tobytes()
            out.append((number % ROUNDS, number, -1, -1, ids, bytes(x is None for x in names), all_counts.tobytes(), _squeezed(codes.astype("<u4")), None, None))
            yield _batch(out, CUT)
            del own, joined, starts, ends, codes, out
            trim()

    return run


def _utf8(text: bytes | None) -> bytes:
    """The text, or nothing where it is null or no UTF-8."""
    try:
        return text if text and text.decode() is not None else b""
    except UnicodeDecodeError:
        return b""


def _answers(a_path: str, b_path: str):
    def run(batches):
        known: dict[bytes, tuple] = {}
        at = None
        for batch in batches:
            for number, part, first, data, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at:
                    at, known = part, {}
                own = aligner(a_path, b_path)
                kind = "<u4" if own.small else "<u8"
                shift = 16 if own.small else 32
                segments = _split(data, np.frombuffer(sizes, "<u4"))
                new = [x for x in segments if x not in known]
                for x, (a, b) in zip(new, own.ids(new), strict=True):
                    if b"".join(map(own.a_bytes.__getitem__, a)) == x == b"".join(map(own.b_bytes.__getitem__, b)):
                        text, n, pairs = links(a, b, own.a_bytes, own.b_bytes)
                        known[x] = (1, len(a), len(b), n), text.encode(), np.array([p << shift | q for p, q in pairs], kind).tobytes(), len(pairs)
                    else:
                        known[x] = (0, 0, 0, 0), b"", b"", 0
                found = [known[x] for x in segments]
                out = (
                    number % ROUNDS, number, first, _squeezed(np.array([x[0] for x in found], "<u4").T), _compressed(b"".join([x[1] for x in found])), _squeezed(np.array([len(x[1]) for x in found], "<u4")),
                    _squeezed(np.frombuffer(b"".join([x[2] for x in found]), kind)), _squeezed(np.array([x[3] for x in found], "<u4")),
                )
                yield _batch([out], ANSWERS)

    return run


def _by_slice(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """All rows of a slice, whose rows follow each other."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _squeezed(values: np.ndarray) -> bytes:
    """Numbers compressed, the first bytes of all before the second ones of all, as they are alike."""
    return _compressed(np.ascontiguousarray(values).view(np.uint8).reshape(-1, values.dtype.itemsize).T.tobytes())


def _compressed(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def _expanded(data: bytes, kind: str = "<u4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.frombuffer(np.frombuffer(_plain(data), np.uint8).reshape(width, -1).T.tobytes(), kind)


def _plain(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data) if data else b""


def _numbers(data: list[bytes], kind: str = "<u4") -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_expanded(x, kind) for x in data)])


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of values, of as many each as counts say."""
    upto = np.append(0, np.cumsum(values, dtype=np.int64))
    ends = np.cumsum(counts, dtype=np.int64)
    return upto[ends] - upto[ends - counts]


def _tallies(small: bool, keep_groups: bool, parts: int):
    kind, shift = ("<u4", 16) if small else ("<u8", 32)

    def run(batches):
        for rows in _by_slice(batches):
            # the slice's own row is the first; then its segments' answers in the order of their codes
            (number, _, names, nulls, counts, codes, *_), *answers = rows
            counts, codes = np.frombuffer(counts, "<u4").astype(np.int64), _expanded(codes).astype(np.int64)
            numbers = np.concatenate([np.zeros((0, 4), "<u4"), *(_expanded(x[6]).reshape(4, -1).T for x in answers)]).astype(np.int64)
            groups = [g for x in answers for g in _split(_plain(x[7]), _expanded(x[8]))]
            pairs, sizes = _numbers([x[9] for x in answers], kind), _numbers([x[10] for x in answers]).astype(np.int64)
            bounds = np.append(0, np.cumsum(counts))
            good = (_sums(numbers[codes, 0], counts) == counts) & (counts > 0)
            per_doc = np.stack([_sums(numbers[codes, k], counts) for k in (1, 2, 3)] + [_sums(sizes[codes], counts)], axis=1)
            per_doc[~good] = 0
            digests, kept = [], []
            for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                text = b";".join(map(groups.__getitem__, codes[a:b].tolist())) if good[k] else b""
                digests.append(hashlib.sha256(text).digest() if good[k] else bytes(32))
                if keep_groups:
                    kept.append(text)
            # Of each document its pairs, each once, and how often it is linked there.
            values, which = np.unique(pairs, return_inverse=True)
            doc = np.repeat(np.arange(len(counts)), counts)
            seen, times = np.unique(doc[good[doc]] * max(len(sizes), 1) + codes[good[doc]], return_counts=True)
            own_doc, own_code = seen // max(len(sizes), 1), seen % max(len(sizes), 1)
            n = sizes[own_code]
            source = np.repeat((np.cumsum(sizes) - sizes)[own_code] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            key = np.repeat(own_doc, n) * max(len(values), 1) + which[source]
            weight = np.repeat(times, n)
            del source, seen, n
            order = np.argsort(key)
            key, weight = key[order], weight[order]
            del order
            begins = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
            often = np.add.reduceat(weight, begins) if len(begins) else np.zeros(0, np.int64)
            key = key[begins]
            pair_doc, pair = key // max(len(values), 1), key % max(len(values), 1)
            in_docs = np.bincount(pair, minlength=len(values))
            used = np.flatnonzero(in_docs)
            part = ((values[used] >> values.dtype.type(shift)).astype(np.int64) * 40503 >> 4) % parts
            by_part = np.argsort(part, kind="stable")
            place = np.zeros(len(values), np.int64)
            place[used[by_part]] = np.arange(len(used))
            chosen = used[by_part]
            edges = np.searchsorted(part[by_part], np.arange(parts + 1)).tolist()
            none = (None,) * 9
            out = [(number, k, x, *none[:-1], _squeezed(in_docs[chosen[x:y]].astype("<u4")), _squeezed(values[chosen[x:y]])) for k, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
            # values are ascending within a part, as used is and the sort is stable
            pair_counts = np.bincount(pair_doc, minlength=len(counts)).astype("<u4")
            out.append((number, -1, -1, names, nulls, per_doc.astype("<i8").tobytes(), b"".join(digests), _compressed(b"".join(kept)), np.array([len(x) for x in kept], "<u4").tobytes(), pair_counts.tobytes(), _squeezed(place[pair].astype("<u4")), _squeezed(often.astype("<u4")), None))
            yield _batch(out, TALLIES)
            del rows, answers, groups, pairs, key, weight, out
            trim()

    return run


def _totals(small: bool):
    kind, shift = ("<u4", 16) if small else ("<u8", 32)

    def added(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        values, which = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        total = np.zeros(len(values), np.int64)
        np.add.at(total, which, np.concatenate([y for _, y in held]))
        return values, total

    def row(part: int, held: list) -> pa.RecordBatch:
        values, total = added(held)
        ids = values >> values.dtype.type(shift)
        begins = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        most = np.repeat(np.maximum.reduceat(total, begins), np.diff(np.append(begins, len(ids))))
        return _batch([(part, _squeezed(values), _squeezed(total.astype("<i8")), (total == most).tobytes())], TOTALS)

    def run(batches):
        held, waiting, at = [], 0, None
        for batch in batches:
            for part, often, pairs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part != at and held:
                    yield row(at, held)
                    held, waiting = [], 0
                at = part
                held.append((_expanded(pairs, kind), _expanded(often).astype(np.int64)))
                waiting += len(held[-1][0])
                if waiting > 1_000_000 and len(held) > 1:
                    held, waiting = [added(held)], 0
        if held:
            yield row(at, held)

    return run


def _replies(small: bool):
    kind = "<u4" if small else "<u8"

    def run(batches):
        values = totals = best = None
        for batch in batches:
            out = []
            for number, first, pairs, total, top in zip(*(batch.column(c).to_pylist() for c in ("slice", "first", "pairs", "totals", "best")), strict=True):
                own = _expanded(pairs, kind)
                if number is None:  # the part's totals come first
                    values, totals, best = own, _expanded(total, "<i8"), np.frombuffer(top, bool)
                    continue
                at = np.searchsorted(values, own)
                out.append((number, first, _squeezed(totals[at]), _compressed(best[at].tobytes())))
            yield _batch(out, REPLIES)

    return run


def _documents(keep_groups: bool):
    def run(batches):
        for rows in _by_slice(batches):
            (_, _, names, nulls, numbers, digests, groups, groups_sizes, counts, codes, often, *_), *replies = rows
            counts, codes, often = np.frombuffer(counts, "<u4").astype(np.int64), _expanded(codes).astype(np.int64), _expanded(often).astype(np.int64)
            totals, best = _numbers([x[11] for x in replies], "<i8"), _numbers([x[12] for x in replies], "?")
            numbers = np.frombuffer(numbers, "<i8").reshape(-1, 4)
            n_best, count_sum = _sums(often * best[codes], counts), _sums(often * totals[codes], counts)
            digest = [digests[32 * k : 32 * k + 32].hex() if numbers[k, 0] else "" for k in range(len(counts))]
            kept = [x.decode() for x in _split(_plain(groups), np.frombuffer(groups_sizes, "<u4"))] if keep_groups else [None] * len(counts)
            columns = [pa.array(np.frombuffer(names, "<i8"), mask=np.frombuffer(nulls, bool)), *(pa.array(numbers[:, k]) for k in range(4)), pa.array(n_best), pa.array(count_sum), pa.array(digest, pa.string()), pa.array(kept, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in DOCUMENTS.split(", ")])

    return run


@dataclass(frozen=True)
class Alignment:
    """documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, groups. pairs: a, b, n_docs,
    best of every id pair that a document links."""

    documents: DataFrame
    pairs: DataFrame


def _together(own: DataFrame, more: DataFrame, parts: int) -> DataFrame:
    """Rows of slices and of answers to them, a slice's in one task and one after the other, its own row first."""
    return own.unionByName(more, allowMissingColumns=True).repartition(parts, "slice").sortWithinPartitions("slice", "first")


def align(docs: DataFrame, *, a_path: str | None = None, b_path: str | None = None, groups: bool = False) -> Alignment:
    """Ids of byte-level BPE (A) for a space and the text, and of SentencePiece BPE (B) for the text, aligned by bytes.

    A text that is null, empty or no UTF-8, or whose ids don't spell it (one that holds U+2581, say), has no tokens: its
    numbers are 0 and its digest is ''. Rows that repeat are documents of their own; null ids stay; other columns are
    left behind; an empty table gives no rows. Whole texts are read. groups: keep the groups' text in `groups`, which is
    null otherwise.

    A task holds a slice of SLICE bytes of texts or one longer text, or the distinct segments or pairs of one part.
    """
    a_path, b_path = a_path or default_paths()[0], b_path or default_paths()[1]
    scratch = Scratch(docs.sparkSession, "alignment")
    small = Pair(a_path, b_path).small
    parts = parts_for(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).collect()[0][0] or 0)
    held = scratch.table(map_arrow(texts(docs), _cut_rows(starters(a_path, b_path), parts), CUT), "cut", partition_by="round")
    n_slices = held.where("round >= 0").count()
    by_part, by_slice = partitions_for(docs.sparkSession, parts, PARTS // 8), partitions_for(docs.sparkSession, n_slices, 4)
    asked = held.where("round = -1").select("slice", "part", "first", "data", "sizes").repartition(by_part, "part").sortWithinPartitions("part")
    answers = scratch.table(map_arrow(asked, _answers(a_path, b_path), ANSWERS), "answers", partition_by="round")
    scratch.drop("cut/round=-1")
    own = held.select("round", "slice", "first", "names", "nulls", "counts", "codes")
    each = []
    for n in range(ROUNDS):
        both = _together(own.where(F.col("round") == n).drop("round"), answers.where(F.col("round") == n).drop("round"), by_slice)
        each.append(scratch.table(map_arrow(both, _tallies(small, groups, parts), TALLIES), f"tallies_{n}"))
        scratch.drop(f"cut/round={n}", f"answers/round={n}")
    tallies = reduce(DataFrame.unionByName, each)
    requests = tallies.where("part >= 0").select("slice", "part", "first", "often", "pairs")
    totals = scratch.table(map_arrow(requests.select("part", "often", "pairs").repartition(by_part, "part").sortWithinPartitions("part"), _totals(small), TOTALS), "totals")
    both = requests.drop("often").unionByName(totals, allowMissingColumns=True).repartition(by_part, "part").sortWithinPartitions("part", F.col("slice").asc_nulls_first())
    replies = scratch.table(map_arrow(both, _replies(small), REPLIES), "replies")
    state = tallies.where("part < 0").select("slice", "first", "names", "nulls", "numbers", "digests", "groups", "groups_sizes", "counts", "codes", "often")
    documents = map_arrow(_together(state, replies, by_slice), _documents(groups), DOCUMENTS)
    return Alignment(documents, map_arrow(totals, _pair_rows(small), "a long, b long, n_docs long, best boolean"))


def _pair_rows(small: bool):
    kind, shift = ("<u4", 16) if small else ("<u8", 32)

    def run(batches):
        for batch in batches:
            for pairs, totals, best in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True):
                values = _expanded(pairs, kind).astype(np.int64)
                columns = [values >> shift, values & ((1 << shift) - 1), _expanded(totals, "<i8"), np.frombuffer(best, bool)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["a", "b", "n_docs", "best"])

    return run
