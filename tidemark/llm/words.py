"""Words of many texts at once, and hashes of words and of runs of words, in numpy.

A word's bytes are mixed eight at a time, by steps that no rearrangement of a word undoes; longer words than LONG take
the library's blake2b. A run's hash is mixed from those of its halves, so runs of any length cost few steps. Equal runs
have equal hashes wherever they stand. Hashes find candidates; where equality decides, operators compare words or use
both lanes, which are independent 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np

#: Words are runs of anything but space and 0x09-0x0D.
_SOLID = np.array([c != 0x20 and not 0x09 <= c <= 0x0D for c in range(256)])
#: Bytes of a word that are mixed in numpy at most.
LONG = 64
LANES = 2
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64)
_FIRST = np.array([0xFF51AFD7ED558CCD, 0xBF58476D1CE4E5B9], np.uint64)
_SECOND = np.array([0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], np.uint64)
_JOIN = np.array([0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix(x: np.ndarray, lane: int = 0) -> np.ndarray:
    """In place, where x is an array of its own."""
    x ^= x >> np.uint64(32)
    x *= _FIRST[lane]
    x ^= x >> np.uint64(29)
    x *= _SECOND[lane]
    x ^= x >> np.uint64(32)
    return x


def grams(hashes: np.ndarray, size: int, lane: int = 0) -> np.ndarray:
    """The hash of the run of `size` words from each word on; runs that reach past the last word are left out."""
    if len(hashes) < size:
        return hashes[:0]

    def joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix(a * _JOIN[lane] + (b ^ (b >> np.uint64(31))), lane)

    h, width = hashes, 1
    while width * 2 <= size:
        h = joined(h[:-width], h[width:])
        width *= 2
    rest = size - width
    h = joined(h[: len(h) - rest], h[rest:]) if rest else h
    return mix(h + np.uint64(size), lane)


def span_hashes(joined: bytes, starts: np.ndarray, ends: np.ndarray, lane: int = 0) -> np.ndarray:
    """A hash of joined[start:end] for each span."""
    size = ends - starts
    padded = joined + bytes(8)
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))  # the bytes from each place on
    out = size.astype(np.uint64) * _JOIN[lane] + _SEEDS[lane]
    out ^= eight[starts] & _LOW[np.minimum(size, 8)]
    out = mix(out, lane)
    active = np.flatnonzero(size > 8)
    for at in range(8, LONG, 8):
        if not len(active):
            break
        own = eight[starts[active] + at] & _LOW[np.minimum(size[active] - at, 8)]
        out[active] = mix(out[active] * _JOIN[lane] ^ own, lane)
        active = active[size[active] > at + 8]
    for k in active.tolist():  # longer ones
        digest = hashlib.blake2b(joined[starts[k] : ends[k]], digest_size=16).digest()
        out[k] = int.from_bytes(digest[8 * lane : 8 * lane + 8], "little")
    return out


class Words:
    """Of each text the words first[k] to first[k + 1]; hashes() has a value for each word."""

    def __init__(self, data: list[bytes | None], *, lower: bool = False):
        joined = b" ".join(x or b"" for x in data)
        self.joined = joined.lower() if lower else joined  # A-Z only
        solid = _SOLID[np.frombuffer(self.joined, np.uint8)].view(np.int8)
        edges = np.diff(solid, prepend=np.int8(0), append=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        offsets = np.cumsum([0, *(len(x or b"") + 1 for x in data)])
        self.first = np.searchsorted(self.starts, offsets)
        self.sizes = np.diff(self.first)

    def hashes(self, lane: int = 0) -> np.ndarray:
        return span_hashes(self.joined, self.starts, self.ends, lane)

    def windows(self, size: int) -> np.ndarray:
        """Indices of the words that start a run of `size` words of one text."""
        at = np.arange(len(self.starts))
        return at[at + size <= np.repeat(self.first[1:], self.sizes)]
