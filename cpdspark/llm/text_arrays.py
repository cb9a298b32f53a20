"""Words, their hashes and counts of many texts at once, as numpy arrays, for use inside tasks."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

BLOCK_BYTES = 1 << 18
_GAP = 8  # blanks behind each text
_BASE = 0x9DDFEA08EB382D69 | 1
_MIX1, _MIX2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "replace")


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[list[bytes]]:
    """Runs of neighbouring texts of about ``limit`` bytes together."""
    run: list[bytes] = []
    size = 0
    for t in texts:
        run.append(t)
        size += len(t) + _GAP
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def slices(texts, limit: int = BLOCK_BYTES) -> Iterator[tuple[slice, list[bytes]]]:
    """Runs of neighbouring texts, encoded one run at a time, so that a batch is never held twice."""
    run: list[bytes] = []
    size = start = 0
    for i, t in enumerate(texts):
        run.append(as_bytes(t))
        size += len(run[-1]) + _GAP
        if size >= limit:
            yield slice(start, i + 1), run
            run, size, start = [], 0, i + 1
    if run:
        yield slice(start, start + len(run)), run


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit numbers so that every bit counts."""
    h = (h ^ (h >> np.uint64(33))) * _MIX1
    h = (h ^ (h >> np.uint64(33))) * _MIX2
    return h ^ (h >> np.uint64(33))


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        base = np.full(size, _BASE, np.uint64)
        inverse = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        base[0] = inverse[0] = 1
        return np.cumprod(base), np.cumprod(inverse)


class Block:
    """Texts side by side in one array; every text ends in blanks."""

    def __init__(self, texts: list[bytes], lower: bool = True):
        self.n = len(texts)
        gap = b" " * _GAP
        data = np.frombuffer(gap.join([*texts, b""]), np.uint8) if texts else np.zeros(0, np.uint8)
        self.raw = data
        self.data = LOWER[data] if lower else data
        self.sizes = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes + _GAP)])

    def text_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def counts(self, mask: np.ndarray) -> np.ndarray:
        """How many places of each text a mask has."""
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return np.diff(total[self.starts])

    def runs(self, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs of bytes of a class (256 booleans)."""
        edge = np.diff(np.concatenate([[False], inside[self.data], [False]]).astype(np.int8))
        return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of maximal runs without white space."""
        return self.runs(~IS_SPACE)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of stretches; equal bytes give equal hashes, also in other blocks."""
        size = 1 << max(19, int(len(self.data)).bit_length())
        power, inverse = _powers(size)
        value = (self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        length = (ends - starts).astype(np.uint64)
        return mixed((total[ends] - total[starts]) * inverse[starts] + length * _MIX2)
