"""What each of five filters removes, in every order of applying them, and its Shapley share.

A document's failures do not depend on the order, so the documents of a part (a source) fall into 32
classes of failed filters. Their counts give, for each of the 32 coalitions of filters, how many
documents the coalition removes together. All that is asked follows from this table:

* A step removes what its coalition removes and the coalition before did not: a difference of two entries.
* The Shapley shares solve a least-squares problem: fit an additive game to the coalition removals under the
  Shapley kernel weights, with the shares bound to sum up to what all filters remove. Its normal equations,
  with the multiplier of the constraint, are solved in rationals, so 120 times a share is a whole number.

Spark does the counting: flags are DataFrame expressions on the text, equal texts meet by SHA-256, rows
of one document, then of one text and part, then of one part and class are added up before each shuffle.
Only the table of at most 32 classes per part reaches Python.

Defined cases: a null text is empty, and an empty text fails only A (and E, if a smaller doc_id has an empty
one); a null source is the part of the empty string. A row with a null doc_id never fails E, is no reason
for another row to fail it, and has no labels. Repeated rows count each; rows that share the smallest
doc_id of a text all pass E. A document is good or toxic if any row of ``labels`` with its id says so. An
empty table gives no rows. Other columns of both tables are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import lru_cache
from itertools import permutations
from math import comb

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cpdspark.functions.lineage import cut

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
MIN_WORDS = 200
MIN_DISTINCT_PERCENT = 50
MAX_CAPITAL_PERCENT = 2
SYMBOLS = r"[#$%&*|]"

_N = len(FILTERS)
_ALL = (1 << _N) - 1
_COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def _text_mask(text: Column, words: Column) -> Column:
    """Bits of the filters A to D."""
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    failed = [
        n < MIN_WORDS,
        distinct * 100 < n * MIN_DISTINCT_PERCENT,
        capitals.cast("long") * 100 > F.length(text).cast("long") * MAX_CAPITAL_PERCENT,
        text.rlike(SYMBOLS),
    ]
    mask = F.lit(0)
    for bit, condition in enumerate(failed):
        mask = mask + condition.cast("int") * (1 << bit)
    return mask


def flagged(documents: DataFrame) -> DataFrame:
    """``doc_id, part, digest, mask, n``: rows of one document, their text's digest, and the bits of A to D."""
    text = F.coalesce("text", F.lit(""))
    part = F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part")
    rows = documents.select("doc_id", part, text.alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), ""))
    mask = _text_mask(F.col("text"), F.col("words")).alias("mask")
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), mask)
    return rows.groupBy("doc_id", "part", "digest", "mask").agg(F.count(F.lit(1)).alias("n"))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    says = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int"))
    marks = labels.dropna(subset=["doc_id"]).groupBy("doc_id").agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    return rows.join(marks, "doc_id", "left").select(
        "doc_id", "part", "digest", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")
    )


def classes(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents by the set of filters they fail, at most 32 rows for a part."""
    rows = cut(_labelled(flagged(documents), labels))
    first = F.min(F.struct("doc_id", "n", "good", "toxic"))
    by_part = rows.dropna(subset=["doc_id"]).groupBy("digest", "part", "mask").agg(first.alias("f"))
    least = by_part.groupBy("digest").agg(F.min("f.doc_id").alias("least"))
    originals = by_part.join(least, "digest").filter(F.col("f.doc_id") == F.col("least")).select("part", "mask", "f.n", "f.good", "f.toxic")
    passing = originals.unionByName(rows.filter("doc_id IS NULL").select("part", "mask", "n", "good", "toxic"))
    # every row as a copy, and the originals moved from the copies to those that pass
    as_copy = lambda df, sign: df.select("part", (F.col("mask") + COPY).alias("mask"), (F.col("n") * sign).alias("n"), "good", "toxic")
    every = as_copy(rows, 1).unionByName(as_copy(passing, -1)).unionByName(passing)
    return every.groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("good"), F.sum(F.col("n") * F.col("toxic")).alias("toxic")
    )


def coalition_removals(counts: dict[int, int]) -> list[int]:
    """For each coalition (as bits), how many documents fail one of its filters."""
    return [sum(n for mask, n in counts.items() if mask & s) for s in range(_ALL + 1)]


def _weight(size: int) -> Fraction:
    return Fraction(_N - 1, comb(_N, size) * size * (_N - size))


@lru_cache(maxsize=1)
def _inverse() -> list[list[Fraction]]:
    """Inverse of the normal matrix, bordered by the constraint, by elimination in rationals."""
    size = _N + 1
    a = [[Fraction(0)] * size + [Fraction(int(i == j)) for j in range(size)] for i in range(size)]
    for s in range(1, _ALL):
        inside = [i for i in range(_N) if s >> i & 1]
        for i in inside:
            for j in inside:
                a[i][j] += _weight(len(inside))
    for i in range(_N):
        a[i][_N] = a[_N][i] = Fraction(1)
    for c in range(size):
        p = next(r for r in range(c, size) if a[r][c])
        a[c], a[p] = a[p], a[c]
        a[c] = [x / a[c][c] for x in a[c]]
        for r in range(size):
            if r != c and a[r][c]:
                f = a[r][c]
                a[r] = [x - f * y for x, y in zip(a[r], a[c])]
    return [row[size:] for row in a]


def shapley(removed: list[int]) -> list[Fraction]:
    """Shapley shares of the filters in ``removed``, a count for each coalition."""
    right = [Fraction(0)] * _N
    for s in range(1, _ALL):
        w = _weight(s.bit_count()) * removed[s]
        for i in range(_N):
            if s >> i & 1:
                right[i] += w
    right.append(Fraction(removed[_ALL]))
    return [sum((x * y for x, y in zip(row, right)), Fraction(0)) for row in _inverse()[:_N]]


def steps(table: list[tuple[int, int, int, int]]) -> list[tuple]:
    """All orders and steps of one part, from its rows ``(mask, n, good, toxic)``."""
    n, good, toxic = (coalition_removals({row[0]: row[k] for row in table}) for k in (1, 2, 3))
    total = sum(row[1] for row in table)
    orders = [tuple(FILTERS.index(x) for x in order) for order in permutations(FILTERS)]
    share = [int(x * len(orders)) for x in shapley(n)]
    out = []
    for order in orders:
        before = 0
        for step, f in enumerate(order, 1):
            now = before | 1 << f
            removed = n[now] - n[before]
            unique = n[_ALL] - n[_ALL ^ 1 << f]
            lost = good[now] - good[before], toxic[now] - toxic[before]
            name = "".join(FILTERS[i] for i in order)
            out.append((name, step, total - n[now], removed, n[1 << f] - removed, unique, *lost, share[f]))
            before = now
    return out


def audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step`` and counts: 600 rows for every part."""
    entry = F.struct("mask", "n", "good", "toxic")
    parts = classes(documents, labels).groupBy("part").agg(F.collect_list(entry).alias("table"))
    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in _COUNTS)

    def ordered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, table in zip(b.part, b.table):
                rows = steps([(x["mask"], x["n"], x["good"], x["toxic"]) for x in table])
                yield pd.DataFrame([(part, *r) for r in rows], columns=["part", "filter_order", "step", *_COUNTS])

    return parts.mapInPandas(ordered, schema)
