"""Words of many texts at once, as numpy arrays over the bytes of an Arrow column.

Texts are taken whole. A word is a maximal run of bytes that are not separators, and is known by a
64-bit hash; sequences of words are known by hashes over those.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

# The bytes that part words, x20 and x09 to x0D.
BLANKS = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
BASE = 0x9E3779B97F4A7C15 | 1
SLICE_BYTES = 1 << 20
SPANS_AT_ONCE = 1 << 12
MASK = (1 << 64) - 1

_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(direction: str, n: int) -> np.ndarray:
    """Powers of the hash base, or of its inverse modulo 2^64."""
    if len(_powers[direction]) < n:
        base = BASE if direction == "up" else pow(BASE, -1, 1 << 64)
        # grown in the tasks; what the driver holds travels with every function, and is kept small
        steps = np.full(-(-n // 4096) * 4096, base, np.uint64)
        steps[0] = 1
        _powers[direction] = np.multiply.accumulate(steps)
    return _powers[direction][:n]


def seed_value(seed: int) -> int:
    return (seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & MASK


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Scramble 64-bit values, so that each bit of the result depends on all bits."""
    x = x + np.uint64(seed_value(seed))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def separators(extra: bytes = b"") -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(BLANKS + extra)] = True
    return out


BLANK = separators()


@dataclass
class Words:
    """The words of a slice of texts; ``first[i]:first[i + 1]`` are those of text ``i``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def hashes(self, data: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes."""
        return span_hashes(self.data if data is None else data, self.starts, self.ends)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and do not overlap.

    It does not depend on where the sums begin, so that they are built for some spans at a time and stay in the cache.
    """
    raw = np.empty(len(starts), np.uint64)
    for at in range(0, len(starts), SPANS_AT_ONCE):
        here = slice(at, at + SPANS_AT_ONCE)
        first, last = starts[at], ends[here][-1]
        sums = np.empty(last - first + 1, np.uint64)
        sums[0] = 0
        wide = data[first:last].astype(np.uint64)
        wide += np.uint64(1)
        wide *= _power("up", len(wide))
        np.cumsum(wide, out=sums[1:])
        raw[here] = (sums[ends[here] - first] - sums[starts[here] - first]) * _power("down", len(wide) + 1)[starts[here] - first]
    return mix(raw ^ (ends - starts).astype(np.uint64))


def split(data: np.ndarray, offsets: np.ndarray, blank: np.ndarray = BLANK) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``; no word spans two texts."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~blank[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return Words(data, starts, ends, np.searchsorted(starts, offsets))


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Consecutive texts of about ``limit`` bytes: first row, end row, bytes, offsets. Nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_binary())
    if texts.null_count:
        texts = texts.fill_null(b"")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def windows(first: np.ndarray, size: int) -> np.ndarray:
    """Positions at which a run of ``size`` words of one text starts."""
    counts = np.diff(first)
    room = np.maximum(counts - size + 1, 0)
    begin = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(room)[:-1])), room)
    return begin + np.arange(room.sum())


def window_hashes(words: np.ndarray, at: np.ndarray, size: int, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of ``size`` words in order, for each start."""
    out = np.zeros(len(at), np.uint64)
    for k in range(size):
        out = out * np.uint64(0xD6E8FEB86659FD93) + mix(words[at + k], seed + 1)
    return mix(out, seed)
