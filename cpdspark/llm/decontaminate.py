"""Benchmark passages in documents by Wu-Manber search.

Texts are reduced to lower-case words, one space behind each. The patterns are the windows of ten words
of the benchmark items (an item of fewer words is one window). They are grouped by length; with ``m``
the shortest of a group and blocks of ``b`` bytes:

- the shift table tells, for the block that ends a window of ``m`` bytes, how far the window can move
  because no pattern has that block further right in its first ``m`` bytes;
- where the shift is 0, the bucket of that block (the suffix of the first ``m`` bytes) lists the
  patterns to try, the first bytes thin them out, and a comparison of all bytes decides.

A block of texts is searched with many cursors side by side, one for each stretch of 2 KB, so that a
step of all cursors is a few array operations and a very long text is many cursors' work.

Documents are never shuffled. The benchmark is the stated query set: it is read in blocks of bounded
size, and the documents pass through one search for each block.

Defined cases: a null or empty text has no words and no hits; an item without words, or with a null id
or text, is left out; items that share an id count once; repeated rows and null doc_ids are judged alone;
an empty benchmark hits nothing; further columns pass through.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from cpdspark.llm.names import others

WINDOW = 10  # words
PATTERN_BYTES = 16 << 20  # of a block of the benchmark
TEXT_BYTES = 1 << 20  # searched at a time
STRETCH = 2048
_TABLE_BITS = 18
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LENGTHS = (1, 4, 8, 16, 32, 64)  # where groups of patterns begin

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str) -> list[bytes]:
    return _WORDS.findall(text.encode("utf-8", "replace").translate(_LOWER.tobytes()))


@dataclass
class _Group:
    """Patterns of similar length, and their tables."""

    m: int
    b: int
    shift: np.ndarray
    suffixes: np.ndarray  # sorted blocks that end the first m bytes of a pattern
    first: np.ndarray  # where a suffix's patterns begin in ``order``
    order: np.ndarray
    head: np.ndarray  # the first bytes of each pattern


class Patterns:
    """The windows of some items, with their tables; bounded by ``PATTERN_BYTES``."""

    def __init__(self, items: dict[bytes, set[str]]):
        self.texts = sorted(items)
        self.items = [sorted(items[p]) for p in self.texts]
        self.n_words = np.array([p.count(b" ") for p in self.texts], np.int64)
        lengths = np.array([len(p) for p in self.texts], np.int64)
        self.lengths = lengths
        self.groups = []
        for low, high in zip(_LENGTHS, [*_LENGTHS[1:], 1 << 62]):
            members = np.flatnonzero((lengths >= low) & (lengths < high))
            if len(members):
                self.groups.append(self._group(members))

    def _group(self, members: np.ndarray) -> _Group:
        m = int(self.lengths[members].min())
        b = max(1, min(8, m // 2))
        rows = np.frombuffer(b"".join(self.texts[i][:m] for i in members), np.uint8).reshape(len(members), m)
        shift = np.full(1 << _TABLE_BITS, m - b + 1, np.int32)
        for end in range(b, m + 1):
            blocks = _as_numbers(rows[:, end - b : end])
            np.minimum.at(shift, _slot(blocks), m - end)
        suffix = _as_numbers(rows[:, m - b :])
        order = np.argsort(suffix, kind="stable")
        suffixes, first = np.unique(suffix[order], return_index=True)
        head = _as_numbers(rows[:, : min(8, m)])
        return _Group(m, b, shift, suffixes, np.append(first, len(order)), members[order], head[order])


def _as_numbers(rows: np.ndarray) -> np.ndarray:
    """Rows of up to 8 bytes as little-endian numbers."""
    out = np.zeros((len(rows), 8), np.uint8)
    out[:, : rows.shape[1]] = rows
    return out.view("<u8").ravel()


def _slot(blocks: np.ndarray) -> np.ndarray:
    return ((blocks * _MIX) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)


def _low_bytes(n: int) -> np.uint64:
    return np.uint64((1 << (8 * n)) - 1)


@dataclass
class _Text:
    """A block of texts as words with one space behind each; ``\\n`` ends a text."""

    data: np.ndarray  # padded
    size: int
    word_at: np.ndarray  # number of the word that a byte is part of
    starts: np.ndarray  # whether a word starts at a byte
    first_word: np.ndarray  # of each text, and the total
    text_of: np.ndarray  # of each word


def _normalised(texts: list[bytes]) -> _Text:
    raw = np.frombuffer(b"\0\0".join(texts) + b"\0\0", np.uint8)
    ends = np.cumsum([len(t) + 2 for t in texts]) - 1
    word = _IS_WORD[raw]
    before = np.zeros_like(word)
    before[1:] = word[:-1]
    keep = word | before
    keep[ends] = True
    data = np.where(word, _LOWER[raw], np.uint8(32))
    data[ends] = 10
    starts = word & ~before
    count = np.cumsum(starts)
    first_word = np.concatenate([[0], count[ends]])
    padded = np.concatenate([data[keep], np.zeros(16, np.uint8)])
    text_of = np.repeat(np.arange(len(texts)), np.diff(first_word))
    return _Text(padded, len(padded) - 16, count[keep] - 1, starts[keep], first_word, text_of)


def _occurrences(t: _Text, patterns: Patterns, g: _Group) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (offset, pattern) of a group."""
    numbers = np.ndarray(t.size + 9, "<u8", t.data.tobytes(), strides=(1,))
    last = t.size - g.m  # where the last window starts
    at = np.arange(0, max(0, last + 1), STRETCH)
    stop = np.minimum(at + STRETCH, last + 1)
    mask, head_mask = _low_bytes(g.b), _low_bytes(min(8, g.m))
    text = t.data.tobytes()
    while len(at):
        block = numbers[at + (g.m - g.b)] & mask
        move = g.shift[_slot(block)]
        zero = move == 0
        if zero.any():
            here, suffix = at[zero], block[zero]
            k = np.minimum(np.searchsorted(g.suffixes, suffix), len(g.suffixes) - 1)
            found = (g.suffixes[k] == suffix) & t.starts[here]
            here, k = here[found], k[found]
            many = g.first[k + 1] - g.first[k]
            place = np.repeat(here, many)
            entry = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(g.first[k], many)
            same = (numbers[place] & head_mask) == g.head[entry]
            place, which = place[same], g.order[entry[same]]
            sure = [text.startswith(patterns.texts[p], o) for o, p in zip(place.tolist(), which.tolist())]
            if any(sure):
                yield place[sure], which[sure]
        at = at + np.maximum(move, 1)
        go = at < stop
        at, stop = at[go], stop[go]


def search(texts: list[bytes], patterns: Patterns) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word numbers (by text and in all), and the occurrences: word at which they start, pattern."""
    t = _normalised(texts)
    found = [x for g in patterns.groups for x in _occurrences(t, patterns, g)]
    if not found:
        return t.first_word, np.zeros(0, np.int64), np.zeros(0, np.int64)
    place, which = (np.concatenate(x) for x in zip(*found))
    return t.first_word, t.word_at[place], which


def _merged(spans: list[tuple[int, int]]) -> list[int]:
    """Flat, disjoint, ascending spans."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def _slices(texts: list[bytes]) -> Iterator[slice]:
    """Runs of texts of about ``TEXT_BYTES``."""
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= TEXT_BYTES:
            yield slice(start, i + 1)
            start, size = i + 1, 0
    if start < len(texts):
        yield slice(start, len(texts))


def _hits(texts: list[bytes], patterns: Patterns) -> Iterator[tuple[int, list[int], list[str]]]:
    """For every text: its words, its hit spans (flat), its items."""
    for part in _slices(texts):
        first, word, which = search(texts[part], patterns)
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        of = np.searchsorted(first, word, side="right") - 1
        for text, start, p in zip(of.tolist(), word.tolist(), which.tolist()):
            start -= int(first[text])
            spans.setdefault(text, []).append((start, start + int(patterns.n_words[p])))
            items.setdefault(text, set()).update(patterns.items[p])
        for i, n in enumerate(np.diff(first).tolist()):
            yield n, _merged(spans.get(i, [])), sorted(items.get(i, ()))


_FOUND = "struct<n_words:long,spans:array<long>,items:array<string>>"


def _blocks(benchmark: DataFrame, window: int, limit: int) -> Iterator[dict[bytes, set[str]]]:
    rows = benchmark.select(F.col("item_id").cast("string").alias("id"), "text").dropna()
    block: dict[bytes, set[str]] = {}
    size = 0
    for row in rows.toLocalIterator():
        words = words_of(row.text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            pattern = b" ".join(words[i : i + window]) + b" "
            size += 0 if pattern in block else len(pattern)
            block.setdefault(pattern, set()).add(row.id)
            if size >= limit:
                yield block
                block, size = {}, 0
    yield block  # the last, also where there is none


def _search_udf(patterns: Broadcast):
    @F.pandas_udf(_FOUND)
    def found(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        tables = Patterns(patterns.value)
        for texts, before in batches:
            new = list(_hits([t.encode("utf-8", "replace") for t in texts], tables))
            for k, (spans, items) in enumerate(zip(before["spans"], before["items"])):
                if spans is not None and len(spans):
                    n, own, own_items = new[k]
                    pairs = [*zip(spans[::2], spans[1::2]), *zip(own[::2], own[1::2])]
                    new[k] = n, _merged([(int(a), int(b)) for a, b in pairs]), sorted({*items, *own_items})
            yield pd.DataFrame(new, columns=["n_words", "spans", "items"])

    return found


def find(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = PATTERN_BYTES) -> DataFrame:
    """All columns and ``found``: ``n_words``, ``spans`` (flat word offsets, end exclusive), ``items``.

    It replaces a column of that name.
    """
    columns = others(documents.columns, "found")
    out = documents.select(*columns, F.lit(None).cast(_FOUND).alias("found"))
    for block in _blocks(benchmark, window, block_bytes):
        search_block = _search_udf(documents.sparkSession.sparkContext.broadcast(block))
        out = out.withColumn("found", search_block(F.coalesce("text", F.lit("")), F.col("found")))
    return out


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Counts and digests for every document row."""
    found = find(documents.select("doc_id", "text"), benchmark)
    spans = F.col("found.spans")
    n_hit = F.aggregate(spans, F.lit(0).cast("long"), lambda total, x: x - total)  # ends less starts
    return found.select(
        "doc_id",
        F.col("found.n_words").alias("n_words"),
        n_hit.alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
