"""NumPy kernels over Arrow text batches: words, shingles and their 64-bit hashes.

A word hash is a polynomial over the word's bytes modulo 2**64, taken from one
running sum over the batch and passed through a bit mixer with the word's length;
a shingle hash mixes its word hashes by position. All work is per slice of about
``SLICE_BYTES``, so memory does not depend on the batch or the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SHINGLE_WORDS = 5
_BASE = 0x9E3779B97F4A7C15 | 1
_U = np.uint64

_space = np.zeros(256, bool)
_space[[0x20, *range(0x09, 0x0E)]] = True
_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """The bit mixer of SplitMix64 (published constants)."""
    x = x.copy()
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


#: Multipliers of the words of a shingle, by place.
_PLACE = mix64(np.arange(1, SHINGLE_WORDS + 1, dtype=np.uint64)) | _U(1)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n - 1."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE_BYTES + 4096)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) per slice of a string column; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + SLICE_BYTES, "right")) - 1
        last = min(len(texts), max(first + 1, last))
        part = offsets[first : last + 1]
        yield first, data[part[0] : part[-1]], part - part[0]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and where each row's words begin (and the end)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    letter = ~_space[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins = letter.copy()
    begins[1:] &= ~letter[:-1] | edge[1:-1]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:] | edge[1:-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power(n)
    run = np.zeros(n + 1, np.uint64)
    folded = _lower[data] if lower else data
    np.cumsum((folded.astype(np.uint64) + _U(1)) * up[:n], out=run[1:])
    h = (run[end] - run[begin]) * down[begin]
    h = mix64(h + (end - begin).astype(np.uint64) * _U(_BASE))
    return h, np.searchsorted(begin, offsets)


def shingle_hashes(words: np.ndarray, rows: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles by row, in order, and where each row's shingles begin.

    A row of fewer words than a shingle has its whole sequence as one; none without words.
    """
    counts = np.diff(rows)
    n = len(words)
    full = np.zeros(n, np.uint64)
    for k in range(min(size, n)):
        full[: n - k] += words[k:] * _PLACE[k]
    place = np.arange(n) - np.repeat(rows[:-1], counts)
    keep = place + size <= np.repeat(counts, counts)
    short = np.flatnonzero((counts > 0) & (counts < size))
    for r in short:
        a, b = rows[r], rows[r + 1]
        full[a] = (words[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + _U(b - a)
        keep[a] = True
    per_row = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    starts = np.zeros(len(rows), np.int64)
    np.cumsum(per_row, out=starts[1:])
    return mix64(full[keep]), starts


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Each row's sorted distinct shingle hashes."""
    for _, data, offsets in slices(texts):
        shingles, starts = shingle_hashes(*word_hashes(data, offsets))
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            own = np.sort(shingles[a:b])
            if len(own) > 1:
                own = own[np.r_[True, own[1:] != own[:-1]]]
            yield own
