"""Words of UTF-8 texts and hashes of words and word windows, as numpy arrays.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. Its hash is the sum of a 64-bit mix of every byte
with its place in the word, mixed again; there is no polynomial whose roots some words could share. Texts
are taken in chunks of about a megabyte, longer ones whole with their hashing cut in slices, so memory is a
small multiple of the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
SLICE = 1 << 17
SEPARATORS = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)

_U = np.uint64
_IN_WORD = np.ones(256, bool)
_IN_WORD[list(SEPARATORS)] = False
_BYTES = np.random.default_rng(20).integers(1, 2**63, 256, dtype=np.uint64)
_PLACE = _U(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit (the SplitMix64 finaliser)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a window from the hashes of its two parts."""
    return mix(left * _U(0xD6E8FEB86659FD93) + right)


def text_chunks(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of a string column as (first row, end row, bytes, row bounds); null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    if len(column) == 0:
        return
    buffers = column.buffers()
    bounds = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + CHUNK, "right")) - 1)
        yield low, high, data[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low]
        low = high


def word_spans(
    data: np.ndarray, bounds: np.ndarray, in_word: np.ndarray = _IN_WORD
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word, and the index of the first word of every text (and the end).

    ``in_word`` says for each byte value whether it belongs to words.
    """
    inside = in_word[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    starts[inner] = inside[inner]
    ends[inner - 1] = inside[inner - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    out = np.zeros(len(starts), _U)
    low = 0
    while low < len(starts):
        base = starts[low]
        high = max(low + 1, int(np.searchsorted(ends, base + SLICE, "right")))
        for at in range(base, ends[high - 1], SLICE):  # several slices only for a longer word
            part = data[at : min(at + SLICE, ends[high - 1])]
            inner = np.clip(starts[low:high] - at, 0, len(part))
            place = np.arange(at, at + len(part)) - np.repeat(starts[low:high], np.diff(inner, append=len(part)))
            sums = np.zeros(len(part) + 1, _U)
            np.cumsum(mix(_BYTES[part] + place.astype(_U) * _PLACE), out=sums[1:])
            out[low:high] += sums[np.clip(ends[low:high] - at, 0, len(part))] - sums[inner]
        low = high
    return mix(out)


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of each run of ``length`` words, from hashes of runs of 1, 2, 4, ... words."""
    if len(words) < length:
        return np.zeros(0, _U)
    whole, size, level, span = None, 0, words, 1
    while True:
        if length & span:
            whole = level if whole is None else joined(whole[: len(level) - size], level[size:])
            size += span
        span *= 2
        if span > length:
            return whole[: len(words) - length + 1]
        level = joined(level[: -span // 2], level[span // 2 :])
