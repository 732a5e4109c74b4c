"""Forced alignment: when each word was said, from a recogniser's scores for every frame.

A word's characters must be emitted in order, each in one frame or more that follow each other, with any number of blank
frames between, and at least one between two equal characters. Of all such ways the best-scoring one is found by dynamic
programming over frames, for many windows at once in numpy; the recogniser itself is a hook (sources.files.run_model).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = 0
#: Cells (windows x frames x states) of one dynamic program.
CELLS = 20_000_000
SPANS = "array<struct<t_start: double, t_end: double>>"


def seconds_per_frame(n_samples: Column, n_frames: Column, sample_rate: int) -> Column:
    """What one frame of scores covers of the sound that it was made from."""
    return n_samples / n_frames / sample_rate


def best_paths(scores: list[np.ndarray], ids: list[np.ndarray]) -> list[np.ndarray | None]:
    """For each window the (first, end) frames of each of its ids; None where they can't all be emitted in its frames.

    scores: log-probabilities, frames x classes. Ties keep to the state that the path is in.
    """
    n = len(scores)
    frames, lengths = np.array([len(x) for x in scores], np.int64), np.array([len(x) for x in ids], np.int64)
    most_t, most_s = int(frames.max(initial=0)), 2 * int(lengths.max(initial=0)) + 1
    if not n or not most_t:
        return [None] * n
    classes = max(x.shape[1] for x in scores)
    score = np.full((n, most_t, classes), -np.inf, np.float64)
    state = np.full((n, most_s), BLANK, np.int64)  # blank, id, blank, id, ..., blank
    for k, (x, own) in enumerate(zip(scores, ids, strict=True)):
        score[k, : len(x), : x.shape[1]] = x
        state[k, 1 : 2 * len(own) : 2] = own
    inside = np.arange(most_s) <= 2 * lengths[:, None]
    skips = np.zeros((n, most_s), bool)  # over a blank between different ids
    skips[:, 3::2] = state[:, 3::2] != state[:, 1:-2:2]
    alpha = np.where(np.arange(most_s) < 2, np.take_along_axis(score[:, 0], state, 1), -np.inf)
    alpha[~inside] = -np.inf
    came, final = np.zeros((most_t, n, most_s), np.int8), np.where((frames == 1)[:, None], alpha, -np.inf)
    for t in range(1, most_t):
        best, own = alpha.copy(), came[t]
        own[:, 1:] = alpha[:, :-1] > alpha[:, 1:]
        np.maximum(best[:, 1:], alpha[:, :-1], out=best[:, 1:])
        over = skips[:, 2:] & (alpha[:, :-2] > best[:, 2:])
        own[:, 2:][over] = 2
        best[:, 2:][over] = alpha[:, :-2][over]
        alpha = best + np.take_along_axis(score[:, t], state, 1)
        alpha[~inside] = -np.inf
        last = frames == t + 1
        final[last] = alpha[last]
    # All windows are followed back together, a frame at a time.
    every, end = np.arange(n), 2 * lengths
    at = np.where((lengths > 0) & ~(final[every, end] > final[every, end - 1]), end - 1, end)
    fits = (lengths > 0) & (final[every, at] != -np.inf)
    spans = np.zeros((n, max(int(lengths.max(initial=0)), 1), 2), np.int64)
    for t in range(most_t - 1, -1, -1):
        on = np.flatnonzero(fits & (t < frames))
        own = at[on]
        odd = own % 2 == 1
        k, j = on[odd], own[odd] // 2
        spans[k, j, 0] = t
        spans[k, j, 1] = np.maximum(spans[k, j, 1], t + 1)
        at[on] = own - came[t, on, own]
    return [spans[k, : lengths[k]] if fits[k] else None for k in range(n)]


def _timed(word_tokens: list | None, span: np.ndarray | None, scale: float, offset: float) -> list:
    """A span in seconds for each word; None for a word without characters, and for all where the window has none."""
    out, first = [], 0
    for own in word_tokens or []:
        n = len(own or [])
        out.append({"t_start": offset + float(span[first, 0]) * scale, "t_end": offset + float(span[first + n - 1, 1]) * scale} if n and span is not None else None)
        first += n
    return out


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tokens, n_frames, scale, offset = (batch.column(k).to_pylist() for k in (1, 3, 4, 5))
        values, bounds = batch.column(2).flatten().to_numpy(zero_copy_only=False), [0, *np.cumsum(batch.column(2).value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).tolist()]
        sizes = [b - a for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        spans: list = [None] * batch.num_rows
        ids = [np.array([i for own in x or [] for i in own or []], np.int64) for x in tokens]
        held: list[int] = []
        longest = 0  # the most ids of a window that is held

        def solve() -> None:
            found = best_paths([values[bounds[k] : bounds[k + 1]].reshape(n_frames[k], -1) for k in held], [ids[k] for k in held])
            for k, own in zip(held, found, strict=True):
                spans[k] = own
            held.clear()

        for k in sorted(range(len(ids)), key=lambda k: n_frames[k] or 0):
            if not len(ids[k]) or not sizes[k] or not n_frames[k] or sizes[k] % n_frames[k] or ids[k].max() >= sizes[k] // n_frames[k]:
                continue  # no words, or no scores that fit them: its words keep the times that they have
            longest = max(longest, len(ids[k])) if held else len(ids[k])
            if held and (len(held) + 1) * n_frames[k] * (2 * longest + 1) > CELLS:
                solve()
                longest = len(ids[k])
            held.append(k)
        if held:
            solve()
        timed = [_timed(t, s, c or 0.0, o or 0.0) for t, s, c, o in zip(tokens, spans, scale, offset, strict=True)]
        kind = pa.list_(pa.struct([("t_start", pa.float64()), ("t_end", pa.float64())]))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(timed, kind)], names=["word_ids", "spans"])


def force_align(windows: DataFrame, sample_rate: int = 16_000) -> DataFrame:
    """word_ids, spans (t_start, t_end in seconds of the recording, null for a word that can't be aligned) of each window.

    windows: word_ids array, tokens (array of each word's ids, see speech.encode_words; none for a word without
    characters), scores (array<float>: log-probabilities, a frame's classes next to each other), n_frames, n_samples,
    t_offset. A window whose words don't fit its frames, or without scores, gives null spans and no error. What comes out
    goes into speech.aligned_updates(). A window's memory is its frames times its states.
    """
    scale = seconds_per_frame(F.col("n_samples"), F.nullif(F.col("n_frames"), F.lit(0)), sample_rate)
    kind = windows.schema["word_ids"].dataType.simpleString()
    return windows.select("word_ids", "tokens", "scores", F.col("n_frames").cast("int"), scale.cast("double"), F.col("t_offset").cast("double")).mapInArrow(_aligned, f"word_ids {kind}, spans {SPANS}")
