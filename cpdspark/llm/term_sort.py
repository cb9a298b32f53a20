"""Sort the word starts of many texts by word, inside one task: pointers are sorted, the bytes stay put.

``sort_words`` is a multikey quicksort whose characters are slices of eight bytes, read as one whole number:
pointers are split into those with a smaller, the same and a greater slice than a pivot's; the middle ones go on
with their next slice. Small ranges are finished at once, slice by slice. Every split keeps the order of
pointers, so equal words stay in the order of the texts.
"""

from __future__ import annotations

import numpy as np

LEAF = 1 << 14
_WIDTH = 8


def padded(data: np.ndarray) -> np.ndarray:
    """Bytes with room for a slice behind the last one."""
    return np.concatenate([data, np.zeros(_WIDTH, np.uint8)])


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: np.ndarray | int) -> np.ndarray:
    """Eight bytes of each word from ``depth`` on, as a number; what lies behind the word is 0."""
    at = np.minimum(starts + depth, len(data) - _WIDTH)
    view = np.ndarray((len(data) - _WIDTH + 1,), ">u8", buffer=data, strides=(1,))
    left = np.clip(ends - starts - depth, 0, _WIDTH)
    shift = (8 * (_WIDTH - left)).astype(np.uint64)
    key = view[at].astype(np.uint64) >> np.minimum(shift, np.uint64(63))
    return np.where(left > 0, key << np.minimum(shift, np.uint64(63)), np.uint64(0))


def _goes_on(key: np.ndarray) -> np.ndarray:
    """Whether a word may have bytes behind this slice: none of the slice's bytes is 0."""
    return (key & np.uint64(0xFF)) != 0


def _finish(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, order: np.ndarray, key: np.ndarray, depth: int):
    """Order of a small range, and where a new word begins in it."""
    at = np.argsort(key, kind="stable")
    order, key = order[at], key[at]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    while True:
        run = np.cumsum(new) - 1
        open_ = _goes_on(key) & (np.bincount(run)[run] > 1)
        if not open_.any():
            return order, new
        depth += _WIDTH
        where = np.flatnonzero(open_)
        sub = order[where]
        deeper = _slices(data, starts[sub], ends[sub], depth)
        at = np.lexsort((deeper, run[where]))
        order[where], deeper = sub[at], deeper[at]
        key = np.zeros(len(key), np.uint64)  # closed ones don't go on
        key[where] = deeper
        same = (run[where][1:] == run[where][:-1]) & (deeper[1:] == deeper[:-1])
        new[where[1:]] = ~same


def sort_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``order`` of the words by their bytes, equal ones as they come, and where a new word begins in it.

    ``data`` is ``padded`` and no word has a zero byte.
    """
    n = len(starts)
    order, new = np.arange(n), np.zeros(n, bool)
    key = _slices(data, starts, ends, 0)
    ranges = [(0, n, 0)] if n else []
    while ranges:
        low, high, depth = ranges.pop()
        own, k = order[low:high], key[low:high]
        if high - low <= LEAF:
            order[low:high], new[low:high] = _finish(data, starts, ends, own, k, depth)
            continue
        sample = np.sort(k[:: max(1, (high - low) // 31)])
        pivot = sample[len(sample) // 2]
        less, more = np.flatnonzero(k < pivot), np.flatnonzero(k > pivot)
        same = np.flatnonzero(k == pivot)
        at = np.concatenate([less, same, more])
        order[low:high], key[low:high] = own[at], k[at]
        first, last = low + len(less), low + len(less) + len(same)
        if pivot & np.uint64(0xFF):
            middle = order[first:last]
            key[first:last] = _slices(data, starts[middle], ends[middle], depth + _WIDTH)
            ranges.append((first, last, depth + _WIDTH))
        else:
            new[first] = True
        ranges += [r for r in ((low, first, depth), (last, high, depth)) if r[0] < r[1]]
    return order, new
