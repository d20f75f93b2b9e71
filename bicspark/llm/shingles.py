"""Sets of word shingles of whole texts, as sorted 64-bit hashes, over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WIDTH = 5
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
# Odd 64-bit numbers; the second is the inverse of the first.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_FACTORS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        row = np.full(max(n, 1 << 20), base, dtype=np.uint64)
        row[0] = 1
        known = _powers[base] = np.multiply.accumulate(row)
    return known[:n]


def words(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of the lower-cased texts, and the number of words of each."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    inside = ~_SPACE[raw]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    first = offsets[:-1][offsets[:-1] < n]
    begin[first] = inside[first]
    starts = np.flatnonzero(begin)
    # A word ends at the next white space, text or end of all.
    stop = ~inside
    stop[first] = True
    stops = np.append(np.flatnonzero(stop), n)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((_LOWER[raw].astype(np.uint64) + np.uint64(1)) * _power(_BASE, n), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _power(_INVERSE, n)[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * _FACTORS[0])
    at = np.searchsorted(starts, offsets)
    return hashes, np.diff(at)


def sets(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after the other, and their number.

    A text with fewer words has its whole sequence as its one shingle.
    """
    hashes, counts = words(texts)
    ends = np.cumsum(counts)
    n = len(hashes)
    owner = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - np.repeat(ends - counts, counts)
    total = np.zeros(n, dtype=np.uint64)
    for k in range(WIDTH):
        # Words beyond the text count as none; only texts with fewer words keep such sums.
        term = np.zeros(n, dtype=np.uint64)
        if k < n:
            term[: n - k] = hashes[k:] * _FACTORS[k]
            term[: n - k][owner[k:] != owner[: n - k]] = 0
        total += term
    keep = (place + WIDTH <= counts[owner]) | ((place == 0) & (counts[owner] < WIDTH))
    short = np.minimum(counts[owner[keep]], WIDTH).astype(np.uint64)
    shingles, owner = mix(total[keep] + short * np.uint64(0x2545F4914F6CDD1D)), owner[keep]
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    fresh = np.ones(len(shingles), dtype=bool)
    fresh[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    shingles, owner = shingles[fresh], owner[fresh]
    return shingles, np.bincount(owner, minlength=len(counts)).astype(np.int64)


def sums_by_run(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The wrapping sum of each run; 0 for an empty one."""
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values, out=sums[1:])
    ends = np.cumsum(counts)
    return sums[ends] - sums[ends - counts]
