"""Statistics of all rows within +-radius of a value, per key.

A band is evaluated on a whole-number grid (``digits`` decimals), so its inclusive ends are
exact. Data is first reduced to distinct (keys, grid) points. Counts are differences of running
totals (exact, integers). Moments are never subtracted: the axis is cut into blocks as wide as
the radius, and a band is the tail of the block before, the block itself, and the head of the
block after. Keys that fit a task are shuffled once for that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cpdspark.functions.lineage import cut
from cpdspark.operators.cumulative import chunks_for, chunks_of, totals_at, with_previous

DIGITS = 6
MOMENTS = {"n": "sum", "s1": "sum", "s2": "sum", "lo": "min", "hi": "max"}
_AGG = {"sum": F.sum, "min": F.min, "max": F.max}


def grid(x: Column, digits: int = DIGITS) -> Column:
    return F.round(x.cast("double") * 10.0**digits).cast("long")


def grid_radius(radius: float, digits: int = DIGITS) -> int:
    return round(radius * 10**digits)


def band_counts(
    points: DataFrame, queries: DataFrame, keys: list[str], pos: str, radius: int, chunks: int | None = None
) -> DataFrame:
    """``queries`` (distinct keys, pos) with ``n``, the sum of ``points.n`` within the radius."""
    ends = F.array(
        F.struct((F.col(pos) + radius).alias("at"), F.lit(1).alias("sign")),
        F.struct((F.col(pos) - radius - 1).alias("at"), F.lit(-1).alias("sign")),
    )
    q = queries.select(*keys, F.col(pos).alias("_origin"), F.explode(ends).alias("_end")).select(
        *keys, F.col("_end.at").alias(pos), "_origin", F.col("_end.sign").alias("_sign")
    )
    totals = totals_at(points, q, keys, pos, {"n": "sum"}, chunks)
    return totals.groupBy(*keys, F.col("_origin").alias(pos)).agg(F.sum(F.col("n") * F.col("_sign")).alias("n"))


def band_distinct(
    points: DataFrame,
    queries: DataFrame,
    keys: list[str],
    value: str,
    pos: str,
    radius: int,
    chunks: int | None = None,
) -> DataFrame:
    """``queries`` with ``n_values``, how many distinct values occur within the radius.

    Around each occurrence a value is visible for +-radius. Overlapping stretches of one value
    are merged, so that the number of open stretches at a position is the number of values.
    """
    vkeys = [*keys, value]
    previous = with_previous(points, vkeys, pos, "_prev", chunks)
    starts = previous.filter(F.col("_prev").isNull() | (F.col(pos) - F.col("_prev") > 2 * radius))
    no_step = F.lit(None).cast("struct<at:bigint,by:bigint>")
    open_step = F.struct((F.col(pos) - radius).alias("at"), F.lit(1).cast("long").alias("by"))
    close_step = F.struct((F.col("_prev") + radius + 1).alias("at"), F.lit(-1).cast("long").alias("by"))
    inner = starts.select(
        *keys, F.explode(F.array(open_step, F.when(F.col("_prev").isNotNull(), close_step).otherwise(no_step))).alias("_s")
    )
    last = points.groupBy(*vkeys).agg((F.max(pos) + radius + 1).alias("at"))
    steps = (
        inner.filter("_s is not null")
        .select(*keys, F.col("_s.at").alias(pos), F.col("_s.by").alias("by"))
        .unionByName(last.select(*keys, F.col("at").alias(pos), F.lit(-1).cast("long").alias("by")))
        .groupBy(*keys, pos)
        .agg(F.sum("by").alias("n_values"))
    )
    return totals_at(steps, queries.select(*keys, pos), keys, pos, {"n_values": "sum"}, chunks)


def moment_points(df: DataFrame, keys: list[str], pos: str, target: str, centre: Column) -> DataFrame:
    """Count, sums and extremes of the target per (keys, pos), centred to keep squares small."""
    y = F.col(target).cast("double") - centre
    return df.groupBy(*keys, pos).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("s1"),
        F.sum(y * y).alias("s2"),
        F.min(target).cast("double").alias("lo"),
        F.max(target).cast("double").alias("hi"),
    )


def band_moments(
    points: DataFrame,
    queries: DataFrame | None,
    keys: list[str],
    pos: str,
    radius: int,
    chunks: int | None = None,
    n_places: int | None = None,
) -> DataFrame:
    """``queries`` (distinct keys, pos) with the :data:`MOMENTS` of all points within the radius.

    Without queries the points ask about themselves. No key has more points than there are positions: if
    these fit one chunk, a key is answered in one task. Otherwise the positions are cut into chunks too.
    ``n_places`` says about how many positions there are; ``points`` are then read once for a key, and
    checkpointed here if they are cut into chunks.
    """
    n_chunks = chunks_for(points.select(pos).distinct()) if n_places is None else chunks_of(n_places)
    if n_chunks <= 1:
        return _moments_by_key(points, queries, keys, pos, radius)
    points = points if n_places is None else cut(points)
    queries = points.select(*keys, pos) if queries is None else queries
    return _moments_by_chunk(points, queries, keys, pos, radius, chunks_for(points) if chunks is None else chunks)


def _block(pos: str, radius: int) -> Column:
    return F.floor(F.col(pos) / F.lit(radius)).cast("long")


def _moments_by_key(points: DataFrame, queries: DataFrame | None, keys: list[str], pos: str, radius: int) -> DataFrame:
    """One shuffle by key; the blocks' heads and tails are running values, found again at the ends of the band."""
    rows = points.select(*keys, pos, *MOMENTS, F.lit(queries is None).alias("_asked"))
    if queries is not None:
        empty = [F.lit(None).cast(points.schema[m].dataType).alias(m) for m in MOMENTS]
        rows = rows.unionByName(queries.select(*keys, pos, *empty, F.lit(True).alias("_asked")))
    rows = (rows.repartition(*keys) if keys else rows).withColumn("_block", _block(pos, radius))
    block, key, start = Window.partitionBy(*keys, "_block"), Window.partitionBy(*keys), Window.unboundedPreceding
    over = lambda w: F.struct("_block", *[_AGG[kind](m).over(w).alias(m) for m, kind in MOMENTS.items()])
    rows = rows.select(
        *keys,
        pos,
        "_asked",
        "_block",
        over(block).alias("_whole"),
        over(block.orderBy(pos).rangeBetween(start, 0)).alias("_head"),
        over(block.orderBy(F.desc(pos)).rangeBetween(start, 0)).alias("_tail"),
    )
    rows = rows.select(
        *keys,
        pos,
        "_asked",
        "_block",
        "_whole",
        F.last("_head").over(key.orderBy(pos).rangeBetween(start, radius)).alias("_head"),
        F.last("_tail").over(key.orderBy(F.desc(pos)).rangeBetween(start, radius)).alias("_tail"),
    )
    # a null key has no middle, and a null position is its own head and tail, as joins and running totals have it
    nowhere, known = F.col("_block").isNull(), F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    parts = [
        F.when(nowhere, F.col("_whole")).when(F.col("_head._block") == F.col("_block") + 1, F.col("_head")),
        F.when(nowhere, F.col("_whole")).when(F.col("_tail._block") == F.col("_block") - 1, F.col("_tail")),
        F.when(known & ~nowhere, F.col("_whole")),
    ]
    fns = {
        "sum": lambda x: F.coalesce(x[0], F.lit(0)) + F.coalesce(x[1], F.lit(0)) + F.coalesce(x[2], F.lit(0)),
        "min": lambda x: F.least(*x),
        "max": lambda x: F.greatest(*x),
    }
    merged = [fns[kind]([p[m] for p in parts]).alias(m) for m, kind in MOMENTS.items()]
    return rows.filter("_asked").select(*keys, pos, *merged)


def _moments_by_chunk(
    points: DataFrame, queries: DataFrame, keys: list[str], pos: str, radius: int, chunks: int
) -> DataFrame:
    block = _block(pos, radius)
    bkeys = [*keys, "_block"]
    p = points.withColumn("_block", block)
    q = queries.select(*keys, F.col(pos).alias("_origin"), block.alias("_b"))
    head = totals_at(
        p,
        q.select(*keys, (F.col("_b") + 1).alias("_block"), (F.col("_origin") + radius).alias(pos), "_origin"),
        bkeys,
        pos,
        MOMENTS,
        chunks,
    )
    tail = totals_at(
        p.withColumn(pos, -F.col(pos)),
        q.select(*keys, (F.col("_b") - 1).alias("_block"), (radius - F.col("_origin")).alias(pos), "_origin"),
        bkeys,
        pos,
        MOMENTS,
        chunks,
    )
    whole = p.groupBy(*bkeys).agg(*merge_moments())
    middle = q.select(*keys, F.col("_b").alias("_block"), "_origin").join(whole, bkeys)
    cols = [*keys, "_origin", *MOMENTS]
    parts = head.select(*cols).unionByName(tail.select(*cols)).unionByName(middle.select(*cols))
    return parts.groupBy(*keys, F.col("_origin").alias(pos)).agg(*merge_moments())


def mean_std(centre: Column) -> tuple[Column, Column]:
    """Mean and sample deviation out of merged :data:`MOMENTS`; equal values give exactly 0."""
    n = F.col("n")
    mean = centre + F.col("s1") / F.when(n > 0, n)
    var = (F.col("s2") - F.col("s1") * F.col("s1") / F.when(n > 0, n)) / F.when(n > 1, n - 1)
    std = F.when(F.col("lo") == F.col("hi"), F.lit(0.0)).otherwise(F.sqrt(F.greatest(var, F.lit(0.0))))
    return F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(mean), F.when(n > 1, std)


def merge_moments() -> list[Column]:
    return [_AGG[kind](m).alias(m) for m, kind in MOMENTS.items()]
