"""Burrows-Wheeler transforms of shards of strings, and their merge by interleave refinement.

A shard's transform is sorted once. The merge never looks at suffixes again: an interleave says for every
place of the merged order which shard its suffix comes from, starting with the shards one after the
other. A round moves every place through the last-to-first mapping (stable by preceding symbol), which
refines the order from the first h symbols to the first h + 1. A border between neighbours that appears
in round h means that they share h symbols, so common prefixes come with the rounds; places without a
border between them are an interval of suffixes that share all symbols so far. Rounds stop when no
border is new.
"""

from __future__ import annotations

import numpy as np


def _stable_order(values: np.ndarray) -> np.ndarray:
    """Stable order of whole numbers below 2**32, by two passes over 16 bits."""
    order = np.argsort((values & 0xFFFF).astype(np.uint16), kind="stable")
    if len(values) and values.max() > 0xFFFF:
        order = order[np.argsort((values[order] >> 16).astype(np.uint16), kind="stable")]
    return order


class Shard:
    """Strings of symbols (1 and more), each followed by an end (0) of its own, and their transform."""

    def __init__(self, symbols: np.ndarray, depth: int):
        """``depth``: symbols by which suffixes are told apart; suffixes that share more keep any order."""
        ends = symbols == 0
        n_ends = int(ends.sum())
        rank = np.where(ends, np.cumsum(ends) - 1, symbols.astype(np.int64) + n_ends - 1).astype(np.int64)
        known = 1
        order = np.argsort(rank, kind="stable")
        while known < depth:
            after = np.zeros_like(rank)
            after[: max(0, len(rank) - known)] = rank[known:]
            after[ends] = 0
            key = (rank << 32) | after
            order = np.argsort(key, kind="stable")
            sorted_key = key[order]
            rank = np.empty_like(rank)
            rank[order] = np.cumsum(np.concatenate([[False], sorted_key[1:] != sorted_key[:-1]]))
            known *= 2
        self.suffixes = order
        self.n_ends = n_ends
        before = np.concatenate([[0], symbols[:-1]])
        self.transform = before[order]  # 0 where a string starts


def merge(shards: list[Shard], depth: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Merge transforms, by ``depth`` symbols at most.

    Returns the interleave (shard of every merged place), the symbols that each place shares with the
    one before (``depth`` where they share that many or more), and for every shard the intervals of its
    suffixes, in the order of ``suffixes``: equal numbers share ``depth`` symbols or all they have.
    """
    transform = np.concatenate([s.transform for s in shards]).astype(np.int64)
    sizes = [len(s.transform) for s in shards]
    of = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    head = np.repeat(np.arange(len(shards), dtype=np.uint16), [s.n_ends for s in shards])
    n_ends = len(head)
    border = np.zeros(len(of), bool)
    border[:1] = True
    common = np.full(len(of), depth, np.int64)
    common[:1] = 0
    for known in range(depth):
        place = np.argsort(of, kind="stable")  # where each shard's rows stand, shard after shard
        symbol = np.empty_like(transform)
        symbol[place] = transform
        source = _stable_order(symbol)[n_ends:]  # all but the starts of strings, which nothing precedes
        interval = np.cumsum(border)[source]
        own = symbol[source]
        new = np.ones(len(of), bool)
        new[n_ends + 1 :] = (own[1:] != own[:-1]) | (interval[1:] != interval[:-1])
        fresh = new & ~border
        common[fresh] = known
        of = np.concatenate([head, of[source]])
        border = new
        if known and not fresh.any():
            break
    place = np.argsort(of, kind="stable")
    return of, common, np.split(np.cumsum(border)[place], np.cumsum(sizes)[:-1])
