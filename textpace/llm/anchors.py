"""Content-chosen anchors of texts, the small numeric core of repeated-passage search.

Every window of ``width`` bytes names the 16-byte string in it with the least hash (the
leftmost of equals) as its anchor. Equal windows have equal anchors at equal places, so
windows need only be compared where their anchors agree.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

GRAM = 16
# Texts are read in pieces of at most this many windows, so that arrays stay small.
PIECE = 1 << 20
_PLACE = np.uint64((1 << 24) - 1)


@dataclass(frozen=True)
class Anchors:
    """One row per anchor, with the run of windows that name it; positions are in the text."""
    row: np.ndarray       # index of the text
    name: np.ndarray      # 48-bit hash of the anchor's bytes
    first: np.ndarray     # first window start
    last: np.ndarray      # last window start
    mark: np.ndarray      # 48-bit hash of all bytes of the run and the anchor's place in it


def _powers(base: int) -> np.ndarray:
    out = np.full(2 * PIECE + 4096, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


# Powers of an odd number and of its inverse modulo 2**64, for hashes of byte ranges.
_UP, _DOWN = _powers(0xA24BAED4963EE407), _powers(pow(0xA24BAED4963EE407, -1, 1 << 64))


def _hashes(data: np.ndarray) -> np.ndarray:
    words = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    h = words[:-8] * np.uint64(0x9E3779B97F4A7C15)
    h ^= (words[8:] + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def _piece(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end, at most about ``PIECE`` bytes."""
    sizes = np.diff(offsets)
    windows = np.maximum(sizes - width + 1, 0)
    if not windows.sum():
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    h = _hashes(data)
    key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    reach, span = width - GRAM + 1, 1
    least = key
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if rest := reach - span:
        least = np.minimum(least[:-rest], least[rest:])
    starts = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(windows)[:-1]]), windows) + np.arange(windows.sum())
    anchor = (least[starts] & _PLACE).astype(np.int64)
    row = np.repeat(np.arange(len(sizes)), windows)
    cut = np.flatnonzero((anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])) + 1
    begin = np.concatenate([[0], cut])
    end = np.concatenate([cut, [len(anchor)]]) - 1
    at, first, last = anchor[begin], starts[begin], starts[end]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(h * _UP[:len(h)], dtype=np.uint64)])
    mark = (sums[last + reach] - sums[first]) * _DOWN[first]
    mark ^= ((at - first) * 64 + (last - first)).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25)
    mark ^= mark >> np.uint64(31)
    mark *= np.uint64(0xD6E8FEB86659FD93)
    base = offsets[row[begin]]
    short = np.uint64(16)
    return (row[begin], (h[at] >> short).astype(np.int64), first - base, last - base,
            (mark >> short).astype(np.int64))


def find(data: np.ndarray, offsets: np.ndarray, width: int) -> Anchors:
    """Anchors of all texts; long texts are read in overlapping pieces."""
    parts, at, n = [], 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, side="right")) - 1)
        to = min(to, n)
        lo, hi = int(offsets[at]), int(offsets[to])
        if to > at + 1 or hi - lo <= 2 * PIECE:
            r, *rest = _piece(data[lo:hi], offsets[at:to + 1] - lo, width)
            parts.append((r + at, *rest))
        else:
            for begin in range(0, max(hi - lo - width + 1, 1), PIECE):
                piece = data[lo + begin:min(hi, lo + begin + PIECE + width - 1)]
                r, name, first, last, mark = _piece(piece, np.array([0, len(piece)]), width)
                parts.append((r + at, name, first + begin, last + begin, mark))
        at = to
    if not parts:
        return Anchors(*[np.zeros(0, np.int64)] * 5)
    return Anchors(*[np.concatenate(x) for x in zip(*parts)])
