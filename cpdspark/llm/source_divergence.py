"""How far the sources of a language differ in their words, pair by pair and term by term, in whole numbers.

Tasks take their documents in shards of Arrow buffers, ordered by language and source. A shard's word starts
are sorted as pointers into its bytes (``term_sort``); a run of equal words gives a term, and within it the
pointers still come by source and document, so counts and document frequencies are differences of positions.
Spark adds up the shards' cells ``(lang, term, source)`` and keeps the terms that enough documents have.

A kept term's share in a group is ``p = 1 + floor(10^9 (count + 2) / (N + 2 V))``. Two groups differ in a term by
``f = floor((p - q)^2 / (p + q))``. Pairs are summed in tiles: the sources of a language are dealt into blocks of
about ``TILE`` by a hash, and a task has the cells of two blocks and of one bucket of terms, as a matrix of
terms and sources. Terms that neither block has add the same for all, and are counted only. So no term
is ever unfolded into pairs of sources, and the task's memory does not depend on the input.

Defined cases: null text, lang and source are empty strings; each row is a document, so null or repeated
ids and repeated rows need no rule; a group without words has counts of 0; where no term is kept, pairs
have value 0 and there are no terms; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from cpdspark.functions.lineage import cut
from cpdspark.llm.term_sort import padded, sort_words
from cpdspark.llm.text_arrays import LOWER

SHARD_BYTES = 16 << 20
MIN_DOCUMENTS = 10
TOP = 10
SCALE = 1_000_000_000
TILE = 128  # sources of a block
BUCKET_CELLS = 1 << 16  # cells that a task of pairs gathers
_MATRIX = 1 << 20  # entries of a matrix of terms and sources at a time

_IS_LETTER = np.zeros(256, bool)
_IS_LETTER[65:91] = _IS_LETTER[97:123] = _IS_LETTER[128:] = True


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of texts that lie side by side; none goes over a text's border."""
    inside = _IS_LETTER[data]
    begin, finish = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    finish[:-1] &= ~inside[1:]
    filled = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][filled], offsets[1:][filled] - 1
    begin[first], finish[last] = inside[first], inside[last]
    return np.flatnonzero(begin), np.flatnonzero(finish) + 1


def _shard(shard: pa.Table) -> pa.RecordBatch | None:
    """Cells ``(lang, source, term, n, docs)`` of one shard."""
    shard = shard.take(pc.sort_indices(shard, [("lang", "ascending"), ("source", "ascending")]))
    lang, source = (shard[c].combine_chunks() for c in ("lang", "source"))
    texts = shard["text"].combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    body = texts.buffers()[2]
    raw = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    starts, ends = _words(raw, offsets)
    if not len(starts):
        return None
    data = padded(LOWER[raw])
    order, new_term = sort_words(data, starts, ends)
    changes = [pc.not_equal(c.slice(1), c.slice(0, len(c) - 1)).to_numpy(zero_copy_only=False) for c in (lang, source)]
    group = np.concatenate([[0], np.cumsum(changes[0] | changes[1])])
    doc = np.searchsorted(offsets, starts[order], side="right") - 1
    new_cell = new_term.copy()
    new_cell[1:] |= np.diff(group[doc]) != 0
    new_doc = new_cell.copy()
    new_doc[1:] |= np.diff(doc) != 0
    at = np.flatnonzero(new_cell)
    n = np.diff(np.append(at, len(order)))
    docs = np.add.reduceat(new_doc.astype(np.int64), at)
    word = order[at]
    length = ends[word] - starts[word]
    border = np.concatenate([[0], np.cumsum(length)])
    taken = np.repeat(starts[word] - border[:-1], length) + np.arange(border[-1])
    term = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(border.astype(np.int64)), pa.py_buffer(data[taken]))
    row = pa.array(doc[at])
    columns = [lang.take(row), source.take(row), term.cast(pa.string()), pa.array(n), pa.array(docs)]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.large_binary())])
    for batch in batches:
        table = pa.Table.from_batches([batch]).cast(kinds)
        sizes = pc.binary_length(table["text"]).to_numpy()
        number = np.cumsum(sizes) // SHARD_BYTES
        borders = [0, *(np.flatnonzero(np.diff(number)) + 1), len(sizes)]
        for low, high in zip(borders, borders[1:]):
            if high > low and (cells := _shard(table.slice(low, high - low))) is not None:
                for i in range(0, cells.num_rows, 100_000):
                    yield cells.slice(i, 100_000)


def _own(documents: DataFrame, *more: Column) -> DataFrame:
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return documents.select(filled("lang"), filled("source"), *more)


def kept_cells(documents: DataFrame, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """``lang, term, source, n, total``: counts of kept terms by source, and in the whole language; ``first``
    marks one cell of each term."""
    rows = _own(documents, F.coalesce("text", F.lit("")).alias("text"))
    cells = rows.mapInArrow(_shards, "lang string, source string, term string, n long, docs long")
    met = cells.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    counted = met.select(
        "lang",
        "term",
        "source",
        "n",
        F.sum("n").over(of_term).alias("total"),
        F.sum("docs").over(of_term).alias("docs"),
        (F.min("source").over(of_term) == F.col("source")).alias("first"),
    )
    return counted.filter(F.col("docs") >= min_documents).drop("docs")


def _share(n: Column | str, whole: str, v: str = "v") -> Column:
    """p for a count: the division is of whole numbers of up to 38 digits."""
    n = F.col(n) if isinstance(n, str) else n
    numerator = F.lit(SCALE).cast("decimal(10,0)") * (n + 2).cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", numerator, (F.col(whole) + 2 * F.col(v)).cast("decimal(19,0)"))


def _distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _groups(documents: DataFrame, kept: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups ``lang, source, whole, v`` with the counts of their kept terms, and languages ``lang, lang_whole, v,
    cells, sources``."""
    occurring = _own(documents).distinct()
    counted = kept.groupBy("lang", "source").agg(
        F.sum("n").alias("whole"), F.sum(F.col("first").cast("long")).alias("v"), F.count(F.lit(1)).alias("cells")
    )
    groups = cut(occurring.join(counted, ["lang", "source"], "left").na.fill(0, ["whole", "v", "cells"]))
    langs = groups.groupBy("lang").agg(
        F.sum("whole").alias("lang_whole"), F.sum("v").alias("v"), F.sum("cells").alias("cells"), F.count(F.lit(1)).alias("sources")
    )
    langs = cut(langs)
    return groups.select("lang", "source", "whole").join(langs.select("lang", "v"), "lang"), langs


def _tile(frame: pd.DataFrame) -> pd.DataFrame:
    """Sums over the bucket's terms for all pairs of its sources that belong to the tile.

    Rows without a term are the sources with their share at count 0, ``p``; the others are cells.
    """
    head = frame[frame.term.isna()].sort_values("source", ignore_index=True)
    cells = frame[frame.term.notna()]
    a, b = int(frame.a.iat[0]), int(frame.b.iat[0])
    column = head.source.searchsorted(cells.source.to_numpy()) if len(cells) else np.zeros(0, np.int64)
    row, terms = pd.factorize(cells.term)
    at = np.argsort(row, kind="stable")
    row, column, share = row[at], np.asarray(column)[at], cells.p.to_numpy(np.int64)[at]
    base, width = head.p.to_numpy(np.int64), len(head)
    total = np.zeros((width, width), np.int64)
    many = max(1, _MATRIX // max(1, width))
    for low in range(0, len(terms), many):
        high = min(low + many, len(terms))
        own = slice(*np.searchsorted(row, [low, high]))
        p = np.tile(base[:, None], (1, high - low))
        p[column[own], row[own] - low] = share[own]
        for i in range(width - 1):
            apart, both = p[i + 1 :] - p[i], p[i + 1 :] + p[i]
            total[i, i + 1 :] += (apart * apart // both).sum(axis=1)
    i, j = np.triu_indices(width, 1)
    if a != b:  # pairs inside one block belong to that block's own tile
        block = head.block.to_numpy()
        i, j = i[block[i] != block[j]], j[block[i] != block[j]]
    names = head.source.to_numpy(object)
    one = {"lang": frame.lang.iat[0], "source": names[i], "item": names[j], "p0": base[i], "q0": base[j]}
    return pd.DataFrame(one | {"value": total[i, j], "seen": np.full(len(i), len(terms))})


def pair_divergence(kept: DataFrame, groups: DataFrame, langs: DataFrame) -> DataFrame:
    """``lang, source, item, value`` for every two sources of a language, in both directions."""
    dealt = langs.select(
        "lang",
        F.ceil(F.col("sources") / TILE).cast("int").alias("blocks"),
        F.greatest(F.lit(1), F.ceil(2 * F.col("cells") / F.ceil(F.col("sources") / TILE) / BUCKET_CELLS)).cast("int").alias("buckets"),
    )
    block = F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int").alias("block")
    least = F.when(F.col("v") > 0, _share(F.lit(0).cast("long"), "whole")).otherwise(F.lit(1)).alias("p")
    placed = cut(groups.join(dealt, "lang").select("*", block, least))
    sides = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(F.least("block", other).alias("a"), F.greatest("block", other).alias("b")),
    )
    tiles = placed.withColumn("t", F.explode(sides)).withColumn("bucket", F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)))
    heads = tiles.select("lang", "t.a", "t.b", "bucket", "source", "block", "p", F.lit(None).cast("string").alias("term"))
    cells = kept.join(placed.drop("p"), ["lang", "source"]).withColumn("t", F.explode(sides))
    cells = cells.select(
        "lang",
        "t.a",
        "t.b",
        F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"),
        "source",
        "block",
        _share("n", "whole").alias("p"),
        "term",
    )
    kind = "lang string, source string, item string, p0 long, q0 long, value long, seen long"
    sums = heads.unionByName(cells).groupBy("lang", "a", "b", "bucket").applyInPandas(_tile, kind)
    both = sums.groupBy("lang", "source", "item", "p0", "q0").agg(F.sum("value").alias("value"), F.sum("seen").alias("seen"))
    rest = (F.col("v") - F.col("seen")) * _distance(F.col("p0"), F.col("q0"))
    pairs = cut(both.join(langs.select("lang", "v"), "lang").select("lang", "source", "item", (F.col("value") + rest).alias("value")))
    flipped = pairs.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    return pairs.unionByName(flipped)


def term_divergence(kept: DataFrame, groups: DataFrame, langs: DataFrame, top: int = TOP) -> DataFrame:
    """``lang, source, item, value, rank``: the terms that a source has more of than its language, up to rank ``top``."""
    known = groups.join(langs.select("lang", "lang_whole"), "lang")
    cells = kept.join(known, ["lang", "source"]).select(
        "lang", "source", F.col("term").alias("item"), _share("n", "whole").alias("p"), _share("total", "lang_whole").alias("q")
    )
    above = cells.filter("p > q").select("lang", "source", "item", _distance(F.col("p"), F.col("q")).alias("value"))
    return _ranked(above).filter(F.col("rank") <= top)


def _ranked(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order))


def audit(documents: DataFrame, min_documents: int = MIN_DOCUMENTS, top: int = TOP) -> DataFrame:
    """``lang, source, part, item, value, rank``: all pairs of sources, and each source's foremost terms."""
    kept = cut(kept_cells(documents, min_documents))
    groups, langs = _groups(documents, kept)
    groups = cut(groups)
    pairs = _ranked(pair_divergence(kept, groups, langs)).withColumn("part", F.lit("pair"))
    terms = term_divergence(kept, groups, langs, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
