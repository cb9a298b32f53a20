"""Exact removal of repeated strings of ``LENGTH`` bytes, by merging shards' Burrows-Wheeler transforms.

Equal strings are brought together by content. Of the 40-byte strings inside a window of 100 bytes, the one
with the least hash is the window's anchor; equal windows have equal anchors at equal places. An anchor
and the neighbouring windows that share it are a piece of text (about 130 bytes).

1. Each batch of documents lists its anchors with a hash of their pieces. Copies of a piece within a batch
   are marked at once, so a passage that everyone has counts once for each batch.
2. Anchors meet by hash. An anchor seen once cannot be repeated. Copies of equal pieces are marked, the
   first one stays. Where an anchor has several different pieces, these are asked for.
3. The pieces asked for are cut out of the texts and dealt to bins by anchor; a piece of an anchor with very
   many pieces is dealt window by window, by the window's own hash, so no bin is bound to one anchor.
4. In a bin, pieces are strings of four-byte symbols in step with their anchors. Shards of pieces are
   transformed and merged by interleave refinement; intervals that share 24 symbols, split by the up to
   four bytes that are left at the ends of a window, are the repeated windows. All but the first are marked.
5. Marks are gathered for each document and their bytes removed.

Between steps, rows are packed arrays for (bucket, batch). The number of buckets follows from the bytes of
all texts, so buckets keep their size. The texts are dealt to buckets once; steps 3 and 5 share that
shuffle.

Defined cases: a null text counts as empty; a null doc_id counts as the greatest; rows with the same doc_id
and different texts are ordered by a hash of the text; rows with the same doc_id and text are the same
document, which is no repeat of itself, and each gets its result; texts of fewer than 100 bytes have no
window and stay; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cpdspark.functions.lineage import cut
from cpdspark.llm.bwt_merge import Shard, merge
from cpdspark.llm.text_arrays import as_bytes, mixed

LENGTH, ANCHOR = 100, 40
REACH = LENGTH - ANCHOR + 1  # anchors of a window
SEGMENT = 1 << 22  # windows looked at together
SYMBOL = 4
DEPTH = LENGTH // SYMBOL - 1  # whole symbols that any window has
BUCKET_BYTES = 4 << 20  # of text
SHARD_SYMBOLS = 1 << 16
MANY = 10_000  # pieces of an anchor from which they are dealt window by window
LAST_ID = (1 << 63) - 1
_BASE = 0x9DDFEA08EB382D69 | 1
_BATCH_TEXT = 16 << 20


def _pack(*columns: np.ndarray) -> bytes:
    """Columns one after the other; whole numbers as differences, which compress well where sorted."""
    n = len(columns[0])
    parts = [np.array([n], "<i8").tobytes()]
    for c in columns:
        parts.append((np.diff(c, prepend=c.dtype.type(0)) if c.dtype.kind == "i" else c).tobytes())
    return b"".join(parts)


def _unpack(blobs, kinds: list[str]) -> list[np.ndarray]:
    out: list[list[np.ndarray]] = [[np.zeros(0, k)] for k in kinds]
    for blob in blobs:
        n, at = int(np.frombuffer(blob, "<i8", 1)[0]), 8
        for k, kind in enumerate(kinds):
            c = np.frombuffer(blob, kind, n, at)
            at += c.nbytes
            out[k].append(np.cumsum(c, dtype=c.dtype) if c.dtype.kind == "i" else c)
    return [np.concatenate(c) for c in out]


#: anchor hash, piece hash, doc_id, tag, first window, windows, place of the anchor
_ANCHORS = ["<u8", "<u8", "<i8", "<i8", "<i8", "<u1", "<u1"]
#: doc_id, tag, first window, windows
_MARKS = ["<i8", "<i8", "<i8", "<i8"]
#: anchor hash, doc_id, tag, first window, windows, place of the anchor, whether dealt by window
_WANTED = ["<u8", "<i8", "<i8", "<i8", "<u1", "<u1", "<u1"]
#: doc_id, tag, first window, bytes, place of the anchor
_PIECES = ["<i8", "<i8", "<i8", "<i8", "<u1"]


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    base, inverse = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    base[0] = inverse[0] = 1
    return np.cumprod(base), np.cumprod(inverse)


def _slide(values: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    done = 1
    while done * 2 <= width:
        values = np.minimum(values[: len(values) - done], values[done:])
        done *= 2
    rest = width - done
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def anchors(text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
    """Anchor hashes, piece hashes, first windows, windows, places of the anchors; in parts for long texts."""
    for begin in range(0, max(0, len(text) - LENGTH + 1), SEGMENT):
        data = np.frombuffer(text, np.uint8)[begin : begin + SEGMENT + LENGTH - 1]
        power, inverse = _powers(1 << max(16, len(data).bit_length()))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])])
        hashes = mixed((total[ANCHOR:] - total[:-ANCHOR]) * inverse[: len(data) - ANCHOR + 1])
        low = np.uint64((1 << 23) - 1)
        key = (hashes & ~low) | (low - np.arange(len(hashes), dtype=np.uint64))  # ties: the last
        at = (low - (_slide(key, REACH) & low)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        count = np.diff(np.append(first, len(at)))
        anchor = at[first]
        end = first + count - 1 + LENGTH
        place = anchor - first
        piece = mixed((total[end] - total[first]) * inverse[first] + count.astype(np.uint64) * np.uint64(61) + place.astype(np.uint64))
        yield hashes[anchor], piece, first + begin, count.astype(np.uint8), place.astype(np.uint8)


def _bucket_of(doc: np.ndarray, tag: np.ndarray, n: int) -> np.ndarray:
    return (np.mod(doc, 1_000_003) * 31 + tag) % n


def _bucket_column(n: int):
    return (F.pmod("doc_id", F.lit(1_000_003)) * 31 + F.col("tag")) % n


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0])) if len(order) else []
    for rows in np.split(order, at[1:]):
        if len(rows):
            yield int(bucket[rows[0]]), rows


def _repeats(order_keys: tuple, same: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows, and whether a row equals the one before in all of ``same``."""
    order = np.lexsort(order_keys)
    equal = np.ones(len(order), bool)
    equal[:1] = False
    for s in same:
        equal[1:] &= s[order][1:] == s[order][:-1]
    return order, equal


def _marks_frame(doc, tag, first, count, n_text: int) -> pd.DataFrame:
    rows = []
    for bucket, k in _by_bucket(_bucket_of(doc, tag, n_text)):
        k = k[np.lexsort((first[k], tag[k], doc[k]))]
        rows.append((bucket, 1, _pack(doc[k], tag[k], first[k], count[k].astype(np.int64))))
    return pd.DataFrame(rows, columns=["bucket", "kind", "blob"])


_ROWS = "bucket long, kind int, blob binary"


def _list_anchors(texts: DataFrame, n_anchor: int, n_text: int) -> DataFrame:
    """Step 1. kind 0: anchors, bucket by hash; kind 1: marks, to be passed on (any bucket)."""

    def batch(docs, tags, texts) -> Iterator[pd.DataFrame]:
        parts = []
        for doc, tag, text in zip(docs, tags, texts):
            for a, p, first, count, place in anchors(text):
                parts.append((a, p, np.full(len(a), doc, np.int64), np.full(len(a), tag, np.int64), first, count, place))
        if not parts:
            return
        a, p, doc, tag, first, count, place = (np.concatenate(c) for c in zip(*parts))
        order, copy = _repeats((first, tag, doc, p, a), [a, p])
        # a row that repeats its twin (same document, same place) is neither sent nor marked
        twin = copy.copy()
        for c in (doc, tag, first):
            twin[1:] &= c[order][1:] == c[order][:-1]
        copies, sent = order[copy & ~twin], np.sort(order[~copy])
        # the first of a run of copies is sent; a copy of a twin differs from its group's first
        if len(copies):
            marks = _marks_frame(doc[copies], tag[copies], first[copies], count[copies], n_text)
            yield marks.assign(bucket=marks.bucket % n_anchor)
        rows = []
        for bucket, k in _by_bucket((a[sent] % np.uint64(n_anchor)).astype(np.int64)):
            k = sent[k]
            rows.append((bucket, 0, _pack(a[k], p[k], doc[k], tag[k], first[k], count[k], place[k])))
        yield pd.DataFrame(rows, columns=["bucket", "kind", "blob"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            start = size = 0
            texts = [as_bytes(t) for t in b.text]
            for i, t in enumerate(texts):
                size += len(t)
                if size >= _BATCH_TEXT or i + 1 == len(texts):
                    part = slice(start, i + 1)
                    yield from batch(b.doc_id[part], b.tag[part], texts[part])
                    start, size = i + 1, 0

    return texts.mapInPandas(run, _ROWS)


def _match_anchors(rows: DataFrame, n_text: int) -> DataFrame:
    """Step 2. kind 1: marks, kind 2: pieces wanted; bucket by document."""

    def meet(frame: pd.DataFrame) -> pd.DataFrame:
        doc, tag, first, count = _unpack(frame.blob[frame.kind == 1], _MARKS)
        marks = [(doc, tag, first, count)]
        a, p, doc, tag, first, count, place = _unpack(frame.blob[frame.kind == 0], _ANCHORS)
        order = np.argsort(a, kind="stable")
        same = a[order][1:] == a[order][:-1]
        live = np.zeros(len(a), bool)
        live[order[1:][same]] = True
        live[order[:-1][same]] = True
        a, p, doc, tag, first, count, place = (c[live] for c in (a, p, doc, tag, first, count, place))
        order, copy = _repeats((first, tag, doc, p, a), [a, p])
        a, p, doc, tag, first, count, place = (c[order] for c in (a, p, doc, tag, first, count, place))
        least = np.maximum.accumulate(np.where(copy, 0, np.arange(len(a))))  # the first of each run of copies
        twin = copy & (doc == doc[least]) & (tag == tag[least]) & (first == first[least])
        k = np.flatnonzero(copy & ~twin)
        marks.append((doc[k], tag[k], first[k], count[k].astype(np.int64)))
        kinds = np.flatnonzero(~copy)
        _, group, pieces = np.unique(a[kinds], return_inverse=True, return_counts=True)
        wanted = kinds[pieces[group] > 1]
        many = (pieces[group] > MANY)[pieces[group] > 1].astype(np.uint8)
        out = [_marks_frame(*(np.concatenate(c) for c in zip(*marks)), n_text)]
        rows = []
        for bucket, k in _by_bucket(_bucket_of(doc[wanted], tag[wanted], n_text)):
            w = wanted[k]
            rows.append((bucket, 2, _pack(a[w], doc[w], tag[w], first[w], count[w], place[w], many[k])))
        out.append(pd.DataFrame(rows, columns=["bucket", "kind", "blob"]))
        return pd.concat(out, ignore_index=True)

    return rows.groupBy("bucket").applyInPandas(meet, _ROWS)


def _cut_pieces(texts: DataFrame, wanted: DataFrame, n_bins: int) -> DataFrame:
    """Step 3. kind 3: pieces and their bytes, by bin."""

    def extract(docs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        a, doc, tag, first, count, place, many = _unpack(rows.blob, _WANTED)
        found = {(d, t): as_bytes(x) for d, t, x in zip(docs.doc_id, docs.tag, docs.text)} if len(a) else {}
        out: dict[int, list[tuple]] = {}
        columns = (c.tolist() for c in (a, doc, tag, first, count, place, many))
        for h, d, t, f, n, o, by_window in zip(*columns):
            text = found[d, t]
            if not by_window:
                out.setdefault(h % n_bins, []).append((d, t, f, o, text[f : f + n - 1 + LENGTH]))
                continue
            for k in range(n):
                window = text[f + k : f + k + LENGTH]
                bin_ = int.from_bytes(hashlib.blake2b(window, digest_size=8).digest(), "little") % n_bins
                out.setdefault(bin_, []).append((d, t, f + k, (o - k) % SYMBOL, window))
        packed = []
        for bin_, pieces in out.items():
            d, t, f, o, x = zip(*sorted(pieces, key=lambda p: p[:3]))
            sizes = np.array([len(y) for y in x], np.int64)
            head = _pack(np.array(d, np.int64), np.array(t, np.int64), np.array(f, np.int64), sizes, np.array(o, np.uint8))
            packed.append((bin_, 3, head + b"".join(x)))
        return pd.DataFrame(packed, columns=["bucket", "kind", "blob"])

    return texts.groupBy("bucket").cogroup(wanted.groupBy("bucket")).applyInPandas(extract, _ROWS)


def repeated_windows(doc, tag, first, place, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Step 4: (piece, window within it) of every repeated window but the first of its kind.

    The pieces must hold every window to be compared; equal windows must be in step with their anchors.
    """
    data = np.frombuffer(b"".join(pieces) + bytes(LENGTH), np.uint8)
    size = np.array([len(p) for p in pieces], np.int64)
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    step = place.astype(np.int64) % SYMBOL  # where the first whole symbol starts
    n_symbols = (size - step) // SYMBOL
    piece = np.repeat(np.arange(len(pieces)), n_symbols)
    number = np.arange(len(piece)) - np.repeat(np.cumsum(n_symbols) - n_symbols, n_symbols)
    at = begin[piece] + step[piece] + number * SYMBOL
    words = np.ndarray(len(data) - 3, ">u4", data.tobytes(), strides=(1,))[at].astype(np.int64)
    _, rank = np.unique(words, return_inverse=True)

    # shards of whole strings; an end behind each
    slot = np.arange(len(piece)) + piece
    symbols = np.zeros(len(piece) + len(pieces), np.int64)
    symbols[slot] = rank + 1
    ends = np.cumsum(n_symbols + 1)
    cuts = np.unique(ends[np.searchsorted(ends, np.arange(SHARD_SYMBOLS, int(ends[-1]), SHARD_SYMBOLS))]) if len(ends) else []
    cuts = [int(c) for c in cuts if c < len(symbols)]
    shards = [Shard(s, DEPTH) for s in np.split(symbols, cuts)]
    _, _, intervals = merge(shards, DEPTH)
    interval = np.empty(len(symbols), np.int64)
    for start, shard, own in zip([0, *cuts], shards, intervals):
        interval[start + shard.suffixes] = own
    interval = interval[slot]

    _, document = np.unique(np.stack([doc, tag], 1), axis=0, return_inverse=True)
    document = document.ravel()
    found: list[np.ndarray] = []
    for before in range(SYMBOL):
        start = at - before  # of a window whose first whole symbol is at ``at``
        inside = (start >= begin[piece]) & (start + LENGTH <= begin[piece] + size[piece])
        k = np.flatnonzero(inside)
        if not len(k):
            continue
        rest = np.zeros(len(k), np.int64)
        for j in range(SYMBOL):
            rest = (rest << 8) | data[start[k] + j if j < before else at[k] + DEPTH * SYMBOL + j - before]
        key = (interval[k] << 32) | rest
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        again = np.zeros(len(k), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        k, key = k[again], key[again]
        window = start[k] - begin[piece[k]]
        place_in_doc = first[piece[k]] + window
        order, copy = _repeats((place_in_doc, document[piece[k]], key), [key])
        least = np.maximum.accumulate(np.where(copy, 0, np.arange(len(k))))
        d, w = document[piece[k]][order], place_in_doc[order]
        later = copy & ((d != d[least]) | (w != w[least]))
        found.append(np.stack([piece[k][order][later], window[order][later]]))
    both = np.concatenate([np.zeros((2, 0), np.int64), *found], axis=1)
    return both[0], both[1]


def _merge_bins(pieces: DataFrame, n_text: int) -> DataFrame:
    """Step 4. kind 1: marks, bucket by document."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        columns, texts = [], []
        for blob in frame.blob:
            columns.append(_unpack([blob], _PIECES))
            body, at = blob[8 + len(columns[-1][0]) * 33 :], 0
            for n in columns[-1][3].tolist():
                texts.append(body[at : at + n])
                at += n
        doc, tag, first, _, place = (np.concatenate(c) for c in zip(*columns))
        piece, window = repeated_windows(doc, tag, first, place, texts)
        order = np.lexsort((window, piece))
        piece, window = piece[order], window[order]
        starts = np.flatnonzero(np.concatenate([[True], (np.diff(piece) != 0) | (np.diff(window) != 1)])[: len(piece)])
        count = np.diff(np.append(starts, len(piece)))
        p = piece[starts]
        return _marks_frame(doc[p], tag[p], first[p] + window[starts], count, n_text)

    return pieces.groupBy("bucket").applyInPandas(one, _ROWS)


def kept_bytes(text: bytes, first: np.ndarray, count: np.ndarray) -> tuple[bytes, int, int]:
    """What is left of a text, the bytes removed and the runs they form."""
    change = np.zeros(len(text) + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + count - 1 + LENGTH, -1)
    gone = np.cumsum(change)[:-1] > 0
    runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def _remove(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """Step 5."""

    def one(docs: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        doc, tag, first, count = _unpack(rows.blob, _MARKS)
        order = np.lexsort((tag, doc))
        doc, tag, first, count = (c[order] for c in (doc, tag, first, count))
        ids = doc.tolist()
        edges = np.flatnonzero(np.concatenate([[True], (np.diff(doc) != 0) | (np.diff(tag) != 0)])[: len(doc)])
        of = {(ids[s], int(tag[s])): slice(s, e) for s, e in zip(edges.tolist(), np.append(edges[1:], len(doc)).tolist())}
        out = []
        for d, t, x in zip(docs.doc_id, docs.tag, docs.text):
            x = as_bytes(x)
            part = of.get((d, t))
            kept, removed, runs = kept_bytes(x, first[part], count[part]) if part else (x, 0, 0)
            out.append((d, len(x), removed, runs, kept))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return texts.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInPandas(one, _RESULT)


def remove_repeats(documents: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept`` (the remaining bytes) for every row."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc_id"),
        F.pmod(F.xxhash64(text), F.lit(1 << 31)).alias("tag"),
        text.alias("text"),
    )
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = total // BUCKET_BYTES + 1
    met = cut(_match_anchors(_list_anchors(rows, n, n), n))
    dealt = rows.withColumn("bucket", _bucket_column(n))
    pieces = _cut_pieces(dealt, met.filter("kind = 2"), n)
    marks = met.filter("kind = 1").unionByName(_merge_bins(pieces, n))
    done = _remove(dealt, marks)
    return done.withColumn("doc_id", F.when(F.col("doc_id") != LAST_ID, F.col("doc_id")))


def report(documents: DataFrame) -> DataFrame:
    kept = F.sha2("kept", 256).alias("kept_sha256")
    return remove_repeats(documents).select("doc_id", "n_bytes", "n_removed", "n_spans", kept)
