"""Words and word hashes of whole Arrow batches in numpy, without a Python loop over words.

Words are the runs ``[^\\x20\\x09-\\x0D]+``. These separators are single bytes in UTF-8, so everything
works on the bytes of the text. Memory beyond a batch is bounded by STEP, except for a single longer word.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

STEP = 1 << 18
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * _BASE)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS, _INVERSES = powers(_BASE, 2 * STEP + 1), powers(_INVERSE, 2 * STEP + 1)


def text_bytes(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    return (np.frombuffer(data, dtype=np.uint8) if data else np.zeros(0, np.uint8)), offsets


def pieces(offsets: np.ndarray):
    """Ranges of rows of about STEP bytes each, at least one row."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + STEP, "right")) - 1)
        yield row, min(end, n)
        row = min(end, n)


def word_bounds(
    data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte bounds of all words, and the index of each row's first word, n + 1 long.

    ``apart`` says of each byte value whether it separates words.
    """
    base = int(offsets[0])
    inside = ~apart[data[base:int(offsets[-1])]]
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    edge = np.zeros(len(inside) + 1, dtype=bool)
    edge[offsets - base] = True
    gap = np.ones(len(inside) + 1, dtype=bool)
    gap[1:-1] = ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(inside & gap[:-1])
    gap[:-1] = edge[:-1]
    gap[:-1] |= ~inside
    ends = np.flatnonzero(inside & gap[1:]) + 1
    return starts + base, ends + base, np.searchsorted(starts, offsets - base)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit polynomial hash of each word, mixed with its length. ``lower`` folds A-Z first."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(ends, base + STEP, "right")))
        part = data[base:int(ends[to - 1])]
        up, down = _POWERS, _INVERSES
        if len(part) >= len(up):
            up, down = powers(_BASE, len(part) + 1), powers(_INVERSE, 1)
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[_LOWER[part] if lower else part] * up[:len(part)], out=sums[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * _BASE)
        at = to
    return out


def beginnings(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int):
    """(rows, hashes) for the first 1, 2, ... ``depth`` bytes of each word that has so many; A-Z count as a-z."""
    at = 0
    while at < len(starts):
        base = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, base + STEP, "right")))
        part = data[base:min(int(ends[to - 1]), int(starts[to - 1]) + depth)]
        up = _POWERS if len(part) <= len(_POWERS) else powers(_BASE, len(part))
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[_LOWER[part]] * up[:len(part)], out=sums[1:])
        s, size = starts[at:to] - base, ends[at:to] - starts[at:to]
        rows = np.arange(to - at)
        for d in range(1, depth + 1):
            rows = rows[size[rows] >= d]
            if not len(rows):
                break
            x = s[rows]
            yield d, rows + at, mix((sums[x + d] - sums[x]) * _INVERSES[x] + np.full(1, d, np.uint64) * _BASE)
        at = to


def fold(hashes: np.ndarray, width: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``width`` word hashes, rolled over prefix sums modulo 2**64."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    if width <= 8:
        total = hashes[:n].copy()
        for j in range(1, width):
            total = total * np.uint64(base) + hashes[j:n + j]
        return mix(total)
    sums = np.zeros(len(hashes) + 1, dtype=np.uint64)
    up = powers(np.uint64(base), len(hashes))
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * powers(np.uint64(pow(base, -1, 1 << 64)), n))
