"""Words and word shingles of whole texts as 64-bit numbers, a batch of documents at a time.

A word is a run of bytes other than space and \\x09-\\x0D of the UTF-8 text with A-Z lower-cased.  Work goes
in slices of some megabytes, so that memory follows the slice and not the batch or a very long text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; temporary arrays take about 40 times as much.
SLICE = 1 << 20

SHINGLE = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BYTE = np.random.default_rng(20240601).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[_SPACE] = 0
_BASE = 0x9E3779B97F4A7C15
_powers = np.ones(1, dtype=np.uint64)


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finalizer of MurmurHash3)."""
    h = h + np.uint64(salt)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def powers(n: int) -> np.ndarray:
    """_BASE to the powers 0 to n - 1, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        grown = np.full(max(n, 1 << 12), _BASE, dtype=np.uint64)
        grown[0] = 1
        _powers = np.cumprod(grown, dtype=np.uint64)
    return _powers[:n]


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the n + 1 places where its texts begin and end; null is empty."""
    column = column.fill_null("").cast(pa.large_string()) if column.null_count else column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _slice_ends(space: np.ndarray, offsets: np.ndarray, start: int) -> int:
    """Where a slice that begins at ``start`` can end without cutting a word."""
    end = start + SLICE
    if end >= len(space):
        return len(space)
    cut = offsets[np.searchsorted(offsets, end, side="right") - 1]
    if cut > start:
        return int(cut)
    gaps = np.flatnonzero(space[end:])  # inside one long text
    after = int(gaps[0]) + end if len(gaps) else len(space)
    bound = int(offsets[np.searchsorted(offsets, start, side="right")])
    return min(after, bound)


def words(buffer: np.ndarray, offsets: np.ndarray, suffixes: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts in order as numbers, and the n + 1 places in them where the texts begin and end.

    A list given as ``suffixes`` receives arrays with the last two bytes of each word as one number.
    """
    space = _SPACE[buffer]
    hashes, starts_at = [], []
    at = 0
    while at < len(buffer):
        end = _slice_ends(space, offsets, at)
        gap = space[at:end]
        first = np.empty(end - at, dtype=bool)
        first[0] = True
        first[1:] = gap[:-1]
        edges = offsets[np.searchsorted(offsets, at, side="left") : np.searchsorted(offsets, end, side="left")] - at
        first[edges[edges < end - at]] = True
        first &= ~gap
        starts = np.flatnonzero(first)
        if len(starts):
            place = np.arange(starts[0], end - at) - np.repeat(starts, np.diff(np.append(starts, end - at)))
            bytes_ = _LOWER[buffer[at + starts[0] : end]]
            place[_SPACE[bytes_]] = 0
            values = _BYTE[bytes_] * powers(int(place.max()) + 1)[place]
            hashes.append(mix(np.add.reduceat(values, starts - starts[0])))
            starts_at.append(starts + at)
            if suffixes is not None:
                last = ~gap
                last[:-1] &= gap[1:] | first[1:]
                ends = np.flatnonzero(last)
                before = np.where(ends > starts, _LOWER[buffer[at + ends - 1]], 0).astype(np.uint16)
                suffixes.append(before << np.uint16(8) | _LOWER[buffer[at + ends]])
        at = end
    if not hashes:
        return np.zeros(0, dtype=np.uint64), np.zeros(len(offsets), dtype=np.int64)
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts_at), offsets, side="left")


def shingle_sets(buffer: np.ndarray, offsets: np.ndarray):
    """For each text in turn its distinct shingles, sorted: runs of five words, or all words where there are fewer."""
    found, bounds = words(buffer, offsets)
    n = max(len(found) - SHINGLE + 1, 0)
    run = np.zeros(n, dtype=np.uint64)
    for k in range(SHINGLE):
        run = run * np.uint64(0xD6E8FEB86659FD93) + found[k : n + k]
    run = mix(run)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= SHINGLE:
            yield np.unique(run[a : b - SHINGLE + 1])
        elif b > a:
            whole = np.uint64(b - a)
            for h in found[a:b]:
                whole = mix(np.array([whole], dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + h, 1)[0]
            yield np.array([whole], dtype=np.uint64)
        else:
            yield np.zeros(0, dtype=np.uint64)
