"""Byte-level BPE by a dynamic programme over prefixes, and decoding.

The ids of a prefix of a piece are those of a shorter prefix and one last token, and only one last token is valid: the
one that merging keeps apart from the token before it. Adjacent tokens stay apart in a whole piece exactly if they stay
apart alone, since no merge before theirs crosses a border that none has crossed. So the last token of each prefix says
the ids of all prefixes: they are followed from the end back. Text that is appended needs the last tokens of its own
bytes only, and after an edit they are made anew until as many of them as the longest token has bytes are as before.

The pattern cuts a text into pieces, each encoded on its own. Whether a piece begins at a place depends on what follows
and never on what came before, so after an edit pieces are cut anew from before it until one begins where one began.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from bisect import bisect_left, bisect_right
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, slices, texts, trim, worker_caches
from tidemark.llm.tokens import UNSAFE, PartEncoder

CACHE = "prefix_bpe"
#: A piece begins where it does because of at most so many characters from its end on (a contraction or white space).
AHEAD = 3
#: Parts of texts and pairs of tokens that a worker remembers at most; it forgets all and begins again.
PARTS, PAIRS = 600_000, 600_000
NONE = 1 << 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


class PrefixBpe:
    """A vocabulary of ranks (base64 of the bytes and the rank, a line each); a token's id is its rank."""

    def __init__(self, path: str):
        import regex
        from public_tokenizers import PATTERN

        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        self.bytes_of = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.longest = max(map(len, self.ranks))
        #: Of each run of bytes that ends a token the token that it is, or -1.
        self.ends_token = {token[k:]: -1 for token in self.ranks for k in range(len(token))} | self.ranks
        self.pieces = regex.compile(PATTERN).findall
        self.spans = regex.compile(PATTERN).finditer
        self.size = len(self.bytes_of)
        self.made = bytearray(self.size)  # 0: not known yet, 1: merging makes the token, 2: it doesn't
        self.apart: dict[int, bool] = {}

    def merged(self, data: bytes) -> list[bytes]:
        """The tokens of short data by merging: the pair of least rank first, of equal ones the leftmost."""
        get, none = self.ranks.get, NONE
        parts = [data[i : i + 1] for i in range(len(data))]
        pairs = [get(data[i : i + 2], none) for i in range(len(data) - 1)]
        while pairs:
            least = min(pairs)
            if least == none:
                break
            at = pairs.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], none)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], none)
        return parts

    def _is_made(self, token: int) -> bool:
        """Whether merging makes the token of its own bytes."""
        if not self.made[token]:
            self.made[token] = 1 if len(self.merged(self.bytes_of[token])) == 1 else 2
        return self.made[token] == 1

    def _stays_apart(self, before: int, token: int) -> bool:
        a, b = self.bytes_of[before], self.bytes_of[token]
        found = self.merged(a + b) == [a, b]
        if len(self.apart) > PAIRS:
            self.apart.clear()
        self.apart[before * self.size + token] = found
        return found

    def last_tokens(self, piece: bytes, known: array | None = None, until: int | None = None) -> array:
        """For each prefix of the piece, from one byte on, its last token. known: those of the first prefixes."""
        last = array("i") if known is None else known
        ends_token, apart, made, size = self.ends_token.get, self.apart.get, self.made, self.size
        for end in range(len(last) + 1, (len(piece) if until is None else until) + 1):
            for begin in range(end - 1, -1, -1):
                token = ends_token(piece[begin:end])
                if token is None:  # nor does any longer run of bytes end a token
                    raise ValueError("the vocabulary lacks a byte")
                if token < 0:
                    continue
                if not begin:
                    if made[token] == 1 or self._is_made(token):
                        last.append(token)
                        break
                    continue
                before = last[begin - 1]
                found = apart(before * size + token)
                if found or (found is None and self._stays_apart(before, token)):
                    last.append(token)
                    break
        return last

    def followed(self, last: array, begin: int, end: int) -> list[int]:
        """The ids of the piece whose prefixes' last tokens are last[begin:end]."""
        ids, bytes_of = [], self.bytes_of
        while end > begin:
            ids.append(last[end - 1])
            end -= len(bytes_of[ids[-1]])
        ids.reverse()
        return ids

    def _piece(self, piece: bytes) -> bytes:
        whole = self.ranks.get(piece)  # also a token that merging would not make
        if whole is not None:
            return array("i", [whole]).tobytes()
        last = self.last_tokens(piece)
        return array("i", self.followed(last, 0, len(last))).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join(self._piece(x.encode()) for x in self.pieces(text))


class Coder(PartEncoder):
    """Texts in slices: each different part of them is encoded once, as long as the worker remembers it."""

    def __init__(self, path: str, limit: int = PARTS):
        self.bpe = PrefixBpe(path)
        self.pieces, self.limit = self.bpe.pieces, limit
        self.cache = {}
        sizes = np.array([len(x) for x in self.bpe.bytes_of])
        self.sizes, self.offsets, self.letters = sizes, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(self.bpe.bytes_of), np.uint8)

    def _whole(self, text: str) -> bytes:
        return self.bpe.encode(text)

    def _words(self, pieces: list[str]) -> list[bytes]:
        return [self.bpe._piece(x.encode()) for x in pieces]

    def _learn(self, parts: list[bytes]) -> None:
        words = []
        for raw in parts:
            word = raw[1:]
            if raw[0] == 0x20 and (word.isalpha() or word.decode("utf-8", "replace").isalpha()):
                words.append(raw)
            else:
                part = raw.decode("utf-8", "replace")
                self.cache[raw] = UNSAFE if part[-1].isspace() else self.bpe.encode(part)
        # In order, a word begins as the one before it does, and prefixes that both have are done.
        bpe, last, before = self.bpe, array("i"), b""
        for raw in sorted(words):
            same, most = 0, min(len(raw), len(before))
            while same < most and raw[same] == before[same]:
                same += 1
            del last[same:]
            before = raw
            bpe.last_tokens(raw, last)
            whole = bpe.ranks.get(raw)
            self.cache[raw] = array("i", bpe.followed(last, 0, len(last)) if whole is None else [whole]).tobytes()

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids; raises for an id that the vocabulary lacks."""
        if len(ids) and int(ids.max()) >= len(self.sizes):
            raise ValueError("an id that the vocabulary lacks")
        sizes = self.sizes[ids]
        upto = np.cumsum(sizes)
        source = np.repeat(self.offsets[ids] - (upto - sizes), sizes)
        source += np.arange(len(source))
        data = self.letters[source].tobytes()
        bounds = np.append(0, upto)[np.append(0, ends)].tolist()
        return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


@dataclass
class Prefixes:
    """A text, where its pieces begin, and for each byte the last token of the piece's prefix that ends with it."""

    text: bytes
    starts: list[int]
    last: array


def prefixes(bpe: PrefixBpe, text: bytes) -> Prefixes:
    whole = Prefixes(b"", [], array("i"))
    return edited(bpe, whole, 0, 0, text)


def ids(bpe: PrefixBpe, of: Prefixes) -> list[int]:
    out = []
    for begin, end in zip(of.starts, [*of.starts[1:], len(of.text)], strict=False):
        whole = bpe.ranks.get(of.text[begin:end]) if end - begin <= bpe.longest else None
        out += bpe.followed(of.last, begin, end) if whole is None else [whole]
    return out


def _char_before(text: bytes, at: int, n: int) -> int:
    """Where the n-th character before the place begins; the start of the text where there are fewer."""
    while n and at > 0:
        at -= 1
        while at > 0 and text[at] & 0xC0 == 0x80:
            at -= 1
        n -= 1
    return at


def edited(bpe: PrefixBpe, of: Prefixes, begin: int, end: int, put: bytes) -> Prefixes:
    """The prefixes of the text with put in place of the bytes begin to end; an append puts at the end. put and what is
    left are whole UTF-8."""
    text = of.text[:begin] + put + of.text[end:]
    moved, settled = len(put) - (end - begin), begin + len(put)
    # Pieces that end AHEAD characters before the edit stay; the first after them is cut anew.
    keep = max(0, bisect_right(of.starts, _char_before(of.text, begin, AHEAD)) - 1)
    at = of.starts[keep] if of.starts else 0
    starts, last = of.starts[:keep], of.last[:at]
    old, tail = of.starts, None
    window = 4096
    while at < len(text) and tail is None:
        # White space and long runs may reach past a window, so one that a piece fills is made longer.
        stop = min(len(text), at + window)
        while stop < len(text) and text[stop] & 0xC0 == 0x80:
            stop += 1
        part = text[at:stop].decode("utf-8")
        sure = len(part) if stop == len(text) else len(part) - AHEAD - 1
        went = at
        for m in bpe.spans(part):
            if m.end() > sure:
                break
            piece = m[0].encode()
            k = bisect_left(old, went - moved) if went >= settled else len(old)
            if k < len(old) and old[k] == went - moved:
                tail = k  # from here on everything is as it was
                break
            starts.append(went)
            last.extend(_renewed(bpe, of, text, went, went + len(piece), begin, end, settled, moved))
            went += len(piece)
        window = 4096 if went > at else window * 4
        at = went
    if tail is not None:
        starts += [x + moved for x in old[tail:]]
        last.extend(of.last[old[tail] :])
    return Prefixes(text, starts, last)


def _renewed(bpe: PrefixBpe, of: Prefixes, text: bytes, start: int, stop: int, begin: int, end: int, settled: int, moved: int) -> array:
    """The last tokens of the piece start to stop of the edited text, taken from those before the edit where they hold."""
    piece = text[start:stop]
    k = bisect_left(of.starts, start)
    known = array("i")
    if start <= begin and k < len(of.starts) and of.starts[k] == start:  # the same piece up to the edit
        until = of.starts[k + 1] if k + 1 < len(of.starts) else len(of.text)
        known = of.last[start : min(begin, until, stop)]
    if stop <= settled + bpe.longest:
        return bpe.last_tokens(piece, known)
    known = bpe.last_tokens(piece, known, max(len(known), settled - start))
    # The old piece that the rest of this one was part of, if it reaches as far.
    k = bisect_right(of.starts, end) - 1
    until = of.starts[k + 1] if k + 1 < len(of.starts) else len(of.text)
    same = 0
    while len(known) < len(piece):
        at = start + len(known) - moved
        if same >= bpe.longest:
            known.extend(of.last[at : min(until, stop - moved)])
            return bpe.last_tokens(piece, known)
        known = bpe.last_tokens(piece, known, len(known) + 1)
        inside = k >= 0 and of.starts[k] <= at < until and at >= end
        same = same + 1 if inside and known[-1] == of.last[at] else 0
    return known


def coder(path: str) -> Coder:
    """One for each worker process."""
    held = worker_caches.setdefault(CACHE, {})
    if path not in held:
        held[path] = Coder(path)
    return held[path]


def encode(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of every whole text. Null counts as empty and has no ids; rows that
    repeat and those without an id have a row each; other columns are left behind; an empty table gives no rows.

    Bytes that are no UTF-8 are encoded as U+FFFD. Letters are those of the pattern library's Unicode tables. Memory: a
    slice of texts, or one longer text with its ids, and two bounded tables in each worker.
    """
    path = path or default_path()

    def run(batches):
        for names, data, _ in slices(batches, keep=CACHE):
            found, ends = coder(path).encode([x or b"" for x in data])
            bounds = [0, *ends.tolist()]
            rows = [found[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(rows, pa.large_binary())], names=["doc_id", "ids"])

    return map_arrow(texts(docs), run, "doc_id long, ids binary")


def decode(encoded: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, text (binary) of rows of encode(); null ids count as none."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            data = [x or b"" for x in batch.column(1).to_pylist()]
            found = coder(path).decode(np.frombuffer(b"".join(data), "<u4"), np.cumsum([len(x) // 4 for x in data], dtype=np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.large_binary())], names=["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text binary")


def encode_decode(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text: encoded, and the ids decoded again.

    Edge cases are those of encode(); an empty text has the digests of nothing.
    """
    path = path or default_path()

    def run(batches):
        for names, data, _ in slices(batches, keep=CACHE):
            found, ends = coder(path).encode([x or b"" for x in data])
            back = [hashlib.sha256(x).hexdigest() for x in coder(path).decode(found, ends)]
            bounds, packed = [0, *(ends * 4).tolist()], memoryview(found.tobytes())
            digests = [hashlib.sha256(packed[a:b]).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            columns = [pa.array(names, pa.int64()), pa.array(np.diff(ends, prepend=0)), pa.array(digests), pa.array(back)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
            del found, packed
            trim()

    return map_arrow(texts(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


PREFIXES = "doc_id long, text binary, starts binary, last binary"


def _packed(names: list, of: list[Prefixes]) -> pa.RecordBatch:
    columns = [pa.array(names, pa.int64()), pa.array([x.text for x in of], pa.large_binary()), pa.array([np.array(x.starts, "<i8").tobytes() for x in of], pa.large_binary()), pa.array([x.last.tobytes() for x in of], pa.large_binary())]
    return pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "starts", "last"])


def _unpacked(text: bytes, starts: bytes, last: bytes) -> Prefixes:
    return Prefixes(text, np.frombuffer(starts, "<i8").tolist(), array("i", last))


def encode_prefixes(docs: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, text, starts, last of every whole text: what append_texts() and edit_texts() go on from. Null is empty."""
    path = path or default_path()

    def run(batches):
        for names, data, _ in slices(batches, most=200_000, keep=CACHE):
            clean = [(x or b"").decode("utf-8", "replace").encode() for x in data]
            yield _packed(names, [prefixes(coder(path).bpe, x) for x in clean])

    return map_arrow(texts(docs), run, PREFIXES)


def edit_texts(held: DataFrame, edits: DataFrame, *, path: str | None = None) -> DataFrame:
    """The rows of encode_prefixes() after edits (doc_id, begin, end, put): put in place of the bytes begin to end, which
    are places in the text as it was. An end before begin counts as begin and places past the text as its end; edits of
    one text must not overlap; of several at one place the one with the greater put comes first. Rows without edits stay.
    """
    path = path or default_path()
    own = edits.where("doc_id IS NOT NULL AND begin IS NOT NULL")
    one = F.struct(F.col("begin").cast("long").alias("begin"), F.coalesce("end", "begin").cast("long").alias("end"), F.coalesce(F.col("put").cast("string"), F.lit("")).cast("binary").alias("put"))
    lists = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.collect_list(one).alias("edits"))

    def run(batches):
        for batch in batches:
            names, out = batch.column(0).to_pylist(), []
            for text, starts, last, asked in zip(*(batch.column(k).to_pylist() for k in range(1, 5)), strict=True):
                state = _unpacked(text, starts, last)
                for e in sorted(asked or [], key=lambda e: (e["begin"], e["put"]), reverse=True):
                    begin = min(max(e["begin"], 0), len(text))
                    state = edited(coder(path).bpe, state, begin, min(max(e["end"], begin), len(text)), e["put"])
                out.append(state)
            yield _packed(names, out)

    return map_arrow(held.join(lists, "doc_id", "left").select("doc_id", "text", "starts", "last", "edits"), run, PREFIXES)


def append_texts(held: DataFrame, more: DataFrame, *, path: str | None = None) -> DataFrame:
    """The rows of encode_prefixes() with the text of `more` (doc_id, text), one row a document at most, at their ends."""
    at = F.lit((1 << 62) - 1)
    return edit_texts(held, more.select("doc_id", at.alias("begin"), at.alias("end"), F.col("text").alias("put")), path=path)


def prefix_ids(held: DataFrame, *, path: str | None = None) -> DataFrame:
    """doc_id, ids of rows of encode_prefixes() as encode() gives them for the text."""
    path = path or default_path()

    def run(batches):
        for batch in batches:
            found = [array("i", ids(coder(path).bpe, _unpacked(*x))).tobytes() for x in zip(*(batch.column(k).to_pylist() for k in range(1, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.large_binary())], names=["doc_id", "ids"])

    return map_arrow(held.select("doc_id", "text", "starts", "last"), run, "doc_id long, ids binary")
