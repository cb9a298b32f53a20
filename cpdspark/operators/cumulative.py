"""Running totals and ranks that do not depend on one key or one task holding little.

A plain ``Window.partitionBy(keys).orderBy(pos)`` puts all positions of a hot key (or, without
keys, the whole table) into one task. Here the position axis is cut at sampled quantiles into
chunks of about ``POINTS_PER_CHUNK``. Running totals are taken within (keys, chunk), and the totals of
earlier chunks, a few rows per key, are added afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cpdspark.functions.lineage import cut

POINTS_PER_CHUNK = 250_000
_SAMPLE_PER_CHUNK = 16
_COARSE = 128  # borders looked at per step of the two-step search

_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def _split_points(points: DataFrame, keys: list[str], pos: str, chunks: int) -> Column:
    """The sorted inner borders of the chunks, and every 128th of them; the size is fixed by ``chunks``.

    They are found once, so that all readers of the chunks use the same, and ``points`` that came out of
    chunks themselves leave no subquery inside a subquery, which the optimizer fails to compare.
    """
    if isinstance(points.schema[pos].dataType, T.NumericType):
        shares = [i / chunks for i in range(1, chunks)]
        borders = points.agg(F.percentile_approx(pos, shares, 20 * max(chunks, 64)).alias("fine"))
    else:
        sample = (
            points.select(pos, *keys)
            .orderBy(F.xxhash64(pos, *keys))
            .limit(chunks * _SAMPLE_PER_CHUNK)
            .agg(F.array_sort(F.collect_list(pos)).alias("_sample"))
        )
        every = F.filter(F.col("_sample"), lambda _, i: i % _SAMPLE_PER_CHUNK == _SAMPLE_PER_CHUNK - 1)
        borders = sample.select(every.alias("fine"))
    coarse = F.filter("fine", lambda _, i: i % _COARSE == _COARSE - 1)
    return cut(borders.select(F.struct("fine", coarse.alias("coarse")).alias("_splits"))).scalar()


def with_chunk(df: DataFrame, points: DataFrame, keys: list[str], pos: str, chunks: int) -> DataFrame:
    """Add ``_chunk``, a number that grows with ``pos``.

    The number comes out of ``explode``: as a plain expression the optimizer would carry it, with its
    lambda over ``pos``, across later joins into places that no longer have ``pos``.
    """
    if chunks <= 1:
        return df.withColumn("_chunk", F.lit(0))
    below = lambda a: F.coalesce(F.size(F.filter(a, lambda s: s < F.col(pos))), F.lit(0))
    searched = df.withColumn("_splits", _split_points(points, keys, pos, chunks))
    number = below(F.col("_splits.fine"))
    if chunks > 2 * _COARSE:
        searched = searched.withColumn("_first", below(F.col("_splits.coarse")) * _COARSE)
        number = F.col("_first") + below(F.slice("_splits.fine", F.col("_first") + 1, _COARSE))
    return searched.select(*df.columns, F.explode(F.array(number)).alias("_chunk"))


def chunks_for(points: DataFrame) -> int:
    """Chunks by the number of points."""
    return chunks_of(points.count())


def chunks_of(n_points: int) -> int:
    return max(1, -(-n_points // POINTS_PER_CHUNK))


def _combine(kind: str, a: Column, b: Column) -> Column:
    if kind == "sum":
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.least(a, b) if kind == "min" else F.greatest(a, b)


def _running(events: DataFrame, keys: list[str], pos: str, measures: dict[str, str], chunks: int) -> DataFrame:
    """Inclusive running value of every measure in (keys, pos) order; equal positions count together."""
    within = Window.partitionBy(*keys, "_chunk").orderBy(pos).rangeBetween(Window.unboundedPreceding, 0)
    out = events.select(
        *[c for c in events.columns if c not in measures],
        *[_AGG[kind](m).over(within).alias(m) for m, kind in measures.items()],
    )
    if chunks <= 1:
        return out
    totals = events.groupBy(*keys, "_chunk").agg(*[_AGG[kind](m).alias(m) for m, kind in measures.items()])
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(
        *keys, "_chunk", *[_AGG[kind](m).over(earlier).alias(f"_before_{m}") for m, kind in measures.items()]
    )
    joined = out.join(before, [*keys, "_chunk"], "left")
    return joined.select(
        *[c for c in events.columns if c not in measures],
        *[_combine(kind, F.col(m), F.col(f"_before_{m}")).alias(m) for m, kind in measures.items()],
    )


def running_totals(
    points: DataFrame, keys: list[str], pos: str, measures: dict[str, str], chunks: int | None = None
) -> DataFrame:
    """``points`` with each measure replaced by its running value up to and with the row's position.

    Here and below ``chunks`` is counted where it is not given.
    """
    chunks = chunks_for(points) if chunks is None else chunks
    events = with_chunk(points, points, keys, pos, chunks)
    return _running(events, keys, pos, measures, chunks).drop("_chunk")


def totals_at(
    points: DataFrame,
    queries: DataFrame,
    keys: list[str],
    pos: str,
    measures: dict[str, str],
    chunks: int | None = None,
) -> DataFrame:
    """For every query row, each measure over the points of its keys with ``point.pos <= query.pos``.

    ``queries`` has the keys, ``pos`` and any other columns; these are kept. Sums are 0 and
    extremes null where no point qualifies.
    """
    chunks = chunks_for(points) if chunks is None else chunks
    carried = [c for c in queries.columns if c not in keys and c != pos]
    p = points.select(*keys, pos, *measures, F.lit(False).alias("_query"), F.lit(None).alias("_carried"))
    q = queries.select(
        *keys,
        pos,
        *[F.lit(None).cast(points.schema[m].dataType).alias(m) for m in measures],
        F.lit(True).alias("_query"),
        F.struct(*carried, F.lit(0).alias("_pad")).alias("_carried"),
    )
    p = p.withColumn("_carried", F.col("_carried").cast(q.schema["_carried"].dataType))
    events = with_chunk(p.unionByName(q), points, keys, pos, chunks)
    out = _running(events, keys, pos, measures, chunks).filter("_query")
    filled = [
        (F.coalesce(F.col(m), F.lit(0)) if kind == "sum" else F.col(m)).alias(m) for m, kind in measures.items()
    ]
    return out.select(*keys, pos, *[F.col(f"_carried.`{c}`").alias(c) for c in carried], *filled)


def with_previous(points: DataFrame, keys: list[str], pos: str, name: str, chunks: int | None = None) -> DataFrame:
    """Distinct (keys, pos) whole-number points with the next smaller position of the same keys, or null."""
    at = totals_at(
        points.select(*keys, pos, F.col(pos).alias(name)),
        points.select(*keys, (F.col(pos) - 1).alias(pos)),
        keys,
        pos,
        {name: "max"},
        chunks,
    )
    return at.select(*keys, (F.col(pos) + 1).alias(pos), name)


def global_rank(df: DataFrame, order: str, name: str = "rank", chunks: int | None = None) -> DataFrame:
    """Number distinct ``order`` values 0, 1, 2, ... over the whole table, without a single-task sort."""
    ranked = running_totals(df.withColumn(name, F.lit(1).cast("long")), [], order, {name: "sum"}, chunks)
    return ranked.withColumn(name, F.col(name) - 1)


def rank_in(df: DataFrame, keys: list[str], order: str, name: str = "rank", chunks: int | None = None) -> DataFrame:
    """Number distinct ``order`` values 0, 1, 2, ... within keys, also for keys too large for one task."""
    ranked = running_totals(df.withColumn(name, F.lit(1).cast("long")), keys, order, {name: "sum"}, chunks)
    return ranked.withColumn(name, F.col(name) - 1)
