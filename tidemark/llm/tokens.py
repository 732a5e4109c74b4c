"""Byte-level BPE ids by the tokenizers library, with a bounded cache of parts.

The pre-tokenizer's pattern lets a space be only the first character of a piece, apart from runs of white space, and a
line break between characters other than white space is a piece of its own. So a text may be cut before every space that
follows a character other than white space, and before such a line break, and the parts encoded alone give the ids of
the whole. A text with any other space is encoded whole.

Equal parts of a slice of texts are found by 128 bits of hashes in numpy, so the cache is asked once for each different
part, and the ids of all texts are gathered from those of the parts.
"""

from __future__ import annotations

import gc
import os

import numpy as np

from tidemark.llm.common import worker_caches
from tidemark.llm.words import span_hashes

#: The name of the encoders among the caches of a worker.
CACHE = "encoders"
#: Stands in the cache for a part after which the text can't be cut.
UNSAFE = b""
_MARKS = np.array([chr(c) in "!#$%&()*+,-./:;<=>?@[]^_`{|}~" for c in range(256)])
_ALNUM = np.array([c < 0x80 and chr(c).isalnum() for c in range(256)])
#: Bytes between which a line break is a piece of its own: before it visible ASCII, after it also the first byte of a
#: character that isn't white space for certain.
_BEFORE = np.array([0x21 <= c <= 0x7E for c in range(256)])
_AFTER = _BEFORE | np.array([0xC3 <= c <= 0xDF or c >= 0xE4 for c in range(256)])
#: Ends every document.
END_ID = 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class PartEncoder:
    """Little-endian unsigned 32-bit ids of texts. Memory is bounded by `limit` cached parts.

    Parts not seen before are cut by the pre-tokenizer's pattern and given to the library's model as words that are
    pre-tokenized, many in a call.
    """

    def __init__(self, path: str, limit: int = 1_300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # a special token's name within a text is ordinary text
        self.model = Tokenizer(self.tokenizer.model)  # neither pre-tokenizer nor special tokens
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.letters = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.letters[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.pieces = regex.compile(PATTERN).findall
        self.limit = limit
        self.cache: dict[bytes, bytes] = {}  # by part, with the space or line break before it

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _words(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that the pattern doesn't cut."""
        return self._mapped([_spelt(x) for x in pieces])

    def _mapped(self, mapped: list[str]) -> list[bytes]:
        out = []
        for first in range(0, len(mapped), 1000):
            words = mapped[first : first + 1000]
            ids = np.array(self.model.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, dtype="<u4")
            # The letters of a word's ids are the word's: that says which are its.
            ends = (np.searchsorted(np.cumsum(self.letters[ids]), np.cumsum([len(x) for x in words])) * 4 + 4).tolist()
            ids = ids.tobytes()
            out += [ids[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    def _learn(self, parts: list[bytes]) -> None:
        cache = self.cache
        new: dict[bytes, str] = {}  # words, and as the model's letters what is encoded for them
        others = []
        for raw in parts:
            word = raw[1:]
            if raw[0] != 0x20:
                others.append(raw)
            elif word.isalpha():  # letters of ASCII
                new[raw] = _SPACE + word.decode("latin-1")
            elif word.decode("utf-8", "replace").isalpha():
                new[raw] = raw.decode("latin-1").translate(_BYTE_LETTERS)
            else:
                others.append(raw)
        cache.update(zip(new, self._mapped(list(new.values())), strict=True))
        texts = [x.decode("utf-8", "replace") for x in others]
        cut = [self.pieces(x) for x in texts]
        found = iter(self._words([piece for pieces in cut for piece in pieces]))
        for raw, part, pieces in zip(others, texts, cut, strict=True):
            ids = b"".join([next(found) for _ in pieces])
            cache[raw] = UNSAFE if part[-1].isspace() else ids

    def encode(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8) one after the other, and where each text's end."""
        collects = gc.isenabled()
        gc.disable()  # many strings and no cycles: the collector would only walk through them
        try:
            return self._encode(data)
        finally:
            if collects:
                gc.enable()

    def _encode(self, data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if not data:
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        if len(self.cache) > self.limit:
            self.cache.clear()
        joined = b" ".join(data)
        letters = np.frombuffer(joined, np.uint8)
        breaks = np.flatnonzero(letters == 0x0A)
        breaks = breaks[(breaks > 0) & (breaks < len(letters) - 1)]
        breaks = breaks[_BEFORE[letters[breaks - 1]] & _AFTER[letters[breaks + 1]]]
        edges = np.sort(np.append(np.flatnonzero(letters == 0x20), breaks), kind="stable")
        starts, ends = np.append(0, edges), np.append(edges, len(joined))
        sizes = np.array([len(x) for x in data], np.int64)
        begins = np.cumsum(sizes + 1) - sizes - 1
        first = np.searchsorted(np.append(0, edges + 1), begins)  # of each text the part without a space before it
        starts[first] = begins
        starts, ends, first = _marks_apart(letters, starts, ends, first)
        bounds = np.append(first, len(starts))
        at = np.ones(len(starts), bool)
        at[first] = False
        at = np.flatnonzero(at)
        own, repeats = distinct(joined, starts[at], ends[at])
        parts = [joined[a:b] for a, b in zip(starts[at[own]].tolist(), ends[at[own]].tolist(), strict=True)]
        get = self.cache.get
        ids = list(map(get, parts))
        if None in ids:
            self._learn([x for x, y in zip(parts, ids, strict=True) if y is None])
            ids = list(map(get, parts))
        heads = [joined[a:b].decode("utf-8", "replace") for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        cut = [self.pieces(x) for x in heads]
        found = iter(self._words([piece for pieces in cut for piece in pieces]))
        entry = np.empty(len(starts), np.int64)
        entry[at], entry[first] = repeats, np.arange(len(parts), len(parts) + len(data))
        ids += [b"".join([next(found) for _ in pieces]) for pieces in cut]
        unsafe = np.fromiter(map(len, ids), np.int64, len(ids)) == 0  # UNSAFE: no part has no ids
        unsafe[len(parts) :] = [x[-1:].isspace() for x in heads]
        nothing = len(ids)
        ids.append(b"")
        # White space before a space, or at the end: the text is encoded whole, or its last part as it stands there.
        for k in np.unique(np.searchsorted(bounds, np.flatnonzero(unsafe[entry]), side="right") - 1).tolist():
            a, b = int(bounds[k]), int(bounds[k + 1]) - 1
            if a == b:
                continue  # a text without a space
            last = joined[starts[b] : ends[b]].decode("utf-8", "replace")
            text = None if len(last) > 1 and not unsafe[entry[a:b]].any() else data[k].decode("utf-8", "replace")
            if text is None:
                ids.append(self._whole(last))
                entry[b] = len(ids) - 1
            else:
                ids.append(self._whole(text))
                entry[a], entry[a + 1 : b + 1] = len(ids) - 1, nothing
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        n = lengths[entry]
        ends_of = np.cumsum(n)
        source = np.repeat((np.cumsum(lengths) - lengths)[entry] - (ends_of - n), n) + np.arange(ends_of[-1])
        return np.frombuffer(b"".join(ids), "<u4")[source], ends_of[bounds[1:] - 1]


def _marks_apart(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The parts, with the marks after a letter or digit that end one as a part of their own, as they are a piece of their
    own; and which parts are the first of a text now."""
    core = ends.copy()
    core[first] = 0
    active = np.flatnonzero(core - starts > 2)
    while len(active):
        active = active[_MARKS[letters[core[active] - 1]]]
        core[active] -= 1
        active = active[core[active] - starts[active] > 2]
    cut = np.flatnonzero((core < ends) & (core - starts >= 2))
    last, before = letters[core[cut] - 1], letters[core[cut] - 2]
    cut = cut[_ALNUM[last] | ((before == 0xC3) & (last != 0x97) & (last != 0xB7))]  # Latin-1 letters have two bytes
    tails = ends[cut]
    ends = ends.copy()
    ends[cut] = core[cut]
    return np.insert(starts, cut + 1, core[cut]), np.insert(ends, cut + 1, tails), first + np.searchsorted(cut, first)


def distinct(joined: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the spans of joined the first of each content, and for each span which of those it repeats."""
    import pandas as pd  # in workers only: it would take the driver's memory

    high, low = (span_hashes(joined, starts, ends, lane) for lane in range(2))
    codes, values = pd.factorize(high)
    own = np.empty(len(values), np.int64)
    own[codes[::-1]] = np.arange(len(codes))[::-1]
    if not (low == low[own][codes]).all():  # two contents have one hash in one lane
        codes, values = pd.factorize(pd.MultiIndex.from_arrays([high, low]))
        own = np.empty(len(values), np.int64)
        own[codes[::-1]] = np.arange(len(codes))[::-1]
    return own, codes


def _letters() -> dict[int, int]:
    """Byte-level BPE writes each byte as a letter: printable Latin-1 as itself, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {b: b for b in plain} | {b: 0x100 + k for k, b in enumerate(sorted(set(range(256)) - set(plain)))}


_BYTE_LETTERS = _letters()
_SPACE = chr(_BYTE_LETTERS[0x20])


def _spelt(piece: str) -> str:
    return piece.encode().decode("latin-1").translate(_BYTE_LETTERS)


_LETTER_BYTES = {chr(letter): byte for byte, letter in _BYTE_LETTERS.items()}


def spelt_bytes(piece: str) -> bytes:
    """The bytes that a vocabulary entry's letters stand for."""
    return bytes(map(_LETTER_BYTES.__getitem__, piece))


def encoder(path: str) -> PartEncoder:
    """One encoder for each worker process."""
    held = worker_caches.setdefault(CACHE, {})
    if path not in held:
        held[path] = PartEncoder(path)
    return held[path]


def document_ids(data: list[bytes | None], path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts, each followed by the end id, as unsigned 32-bit integers, and where each text's end; null counts as empty."""
    ids, ends = encoder(path).encode([x or b"" for x in data])
    return np.insert(ids, ends, END_ID), ends + np.arange(1, len(ends) + 1)
