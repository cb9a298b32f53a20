"""Conditional distributions estimated from a table by co-occurrence.

Every estimator takes the observed table and, optionally, the distinct tuples asked for, and
returns one row per tuple. Without tuples the observed table asks about itself. Rows are never
joined with rows: the table is reduced to distinct tuples first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cpdspark.functions import distributions as dist
from cpdspark.functions.lineage import cut
from cpdspark.operators.bands import (
    DIGITS,
    band_counts,
    band_distinct,
    band_moments,
    grid,
    grid_radius,
    mean_std,
    moment_points,
)
from cpdspark.operators.cumulative import chunks_for
from cpdspark.operators.counts import domain, domain_size
from cpdspark.plans.spec import Kind, Node, Role

POS = "_pos"
WEIGHT = "_weight"  # rows behind a tuple, in tables that were reduced beforehand


def row_count(obs: DataFrame) -> Column:
    return F.sum(WEIGHT) if WEIGHT in obs.columns else F.count(F.lit(1))


def sketch(obs: DataFrame, groups: list[list]) -> tuple[int, list[int]]:
    """Rows, and about how many distinct tuples each group of columns has: one pass without a shuffle."""
    if not groups:
        return 0, []
    n, *distinct = obs.agg(F.count(F.lit(1)), *[F.approx_count_distinct(F.struct(*g), 0.05) for g in groups]).first()
    return n, distinct


def reduced(obs: DataFrame, attrs: list[str], n_tuples: int, n_rows: int, share: float = 0.1) -> DataFrame | None:
    """Distinct tuples of ``attrs`` with their rows, from which several nodes can be counted.

    None if, by :func:`sketch`, there are more than ``share`` as many as rows.
    """
    if n_tuples > share * n_rows:
        return None
    return cut(obs.groupBy(*attrs).agg(F.count(F.lit(1)).alias(WEIGHT)))


def with_position(df: DataFrame, node: Node, digits: int = DIGITS) -> DataFrame:
    """Add the band parent's grid position, if the node has a band."""
    return df.withColumn(POS, grid(F.col(node.band.attr), digits)) if node.band else df


def lookup_keys(node: Node) -> list[str]:
    """Columns that identify what a node's distribution is conditioned on."""
    return node.by_role(Role.CAT, Role.SOFT, Role.HARD) + ([POS] if node.band else [])


def global_moments(obs: DataFrame, attr: str) -> Column:
    y = F.col(attr).cast("double")
    return obs.agg(F.struct(F.avg(y).alias("m"), F.stddev_samp(y).alias("s"))).scalar()


def roots(obs: DataFrame, node: Node, self_scoring: bool) -> DataFrame | Column:
    """A root's log probability: a column if it is the same for all rows, else a table per value."""
    if node.kind is Kind.UNIFORM:
        if self_scoring:
            return dist.uniform_categorical(domain_size(obs, node.attr))
        return domain(obs, node.attr).withColumn("lp", dist.uniform_categorical(domain_size(obs, node.attr)))
    total = obs.agg(row_count(obs)).scalar()
    counts = obs.groupBy(node.attr).agg(row_count(obs).alias("n"))
    return counts.select(node.attr, dist.named_categorical(F.col("n"), total).alias("lp"))


def categorical(obs: DataFrame, node: Node, asked: DataFrame | None = None) -> DataFrame:
    """Log probability per (parents, value): seen values by their share, unseen ones share a tenth.

    ``asked`` holds distinct parent and target values, with the position of a band.
    """
    left = node.by_role(Role.CAT, Role.SOFT)
    if node.band:
        return _categorical_band(obs, node, left, asked)
    joint = cut(obs.groupBy(*left, node.attr).agg(row_count(obs).alias("c")))
    total = joint.groupBy(*left).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("seen"))
    base = joint if asked is None else asked.join(joint, [*left, node.attr], "left")
    return smoothed(base.join(total, left, "left"), [*left, node.attr], domain_size(joint, node.attr))


def smoothed(df: DataFrame, keys: list[str], size: Column) -> DataFrame:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    counted = df.withColumn("_d", size)
    p = dist.smoothed_categorical(zero("c"), zero("total"), zero("seen"), F.col("_d"))
    return counted.select(*keys, dist.safe_ln(p).alias("lp"), (zero("total") > 0).alias("support"))


def band_points(obs: DataFrame, node: Node, left: list[str]) -> DataFrame:
    """Rows per distinct (parents, position, value)."""
    return cut(with_position(obs, node).groupBy(*left, POS, node.attr).agg(F.count(F.lit(1)).alias("n")))


def band_value_counts(points: DataFrame, node: Node, left: list[str], asked: DataFrame | None) -> DataFrame:
    """Per asked (parents, position, value): matches with the value, matches, distinct values seen."""
    v, r = node.attr, grid_radius(node.band.radius)
    chunks = chunks_for(points)
    asked = points.select(*left, POS, v) if asked is None else asked
    places = asked.select(*left, POS).distinct()
    by_place = points.groupBy(*left, POS).agg(F.sum("n").alias("n"))
    with_value = band_counts(points, asked, [*left, v], POS, r, chunks).withColumnRenamed("n", "c")
    total = band_counts(by_place, places, left, POS, r, chunks).withColumnRenamed("n", "total")
    seen = band_distinct(points, places, left, v, POS, r, chunks).withColumnRenamed("n_values", "seen")
    return with_value.join(total.join(seen, [*left, POS]), [*left, POS])


def _categorical_band(obs: DataFrame, node: Node, left: list[str], asked: DataFrame | None) -> DataFrame:
    points = band_points(obs, node, left)
    counts = band_value_counts(points, node, left, asked)
    return smoothed(counts, [*left, POS, node.attr], domain_size(points, node.attr))


def numerical(obs: DataFrame, node: Node, asked: DataFrame | None = None) -> DataFrame:
    """Mean and sample deviation per parents; the whole table's where at most one row matches."""
    left = node.by_role(Role.CAT, Role.SOFT)
    stats = numerical_matches(obs, node, left, asked)
    keys = left + ([POS] if node.band else [])
    return fallback_to_whole(stats, keys, global_moments(obs, node.attr))


def fallback_to_whole(stats: DataFrame, keys: list[str], whole: Column) -> DataFrame:
    lone = F.coalesce(F.col("n"), F.lit(0)) <= 1
    return stats.withColumn("_g", whole).select(
        *keys,
        F.coalesce(F.col("n"), F.lit(0)).alias("n"),
        F.when(lone, F.col("_g.m")).otherwise(F.col("mean")).alias("mean"),
        F.when(lone, F.col("_g.s")).otherwise(F.col("std")).alias("std"),
    )


def numerical_matches(obs: DataFrame, node: Node, left: list[str], asked: DataFrame | None) -> DataFrame:
    """Number of matches, mean and deviation per asked tuple, before any fallback."""
    y = F.col(node.attr).cast("double")
    if not node.band:
        local = obs.groupBy(*left).agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(y).alias("mean"),
            F.when(F.min(y) == F.max(y), F.lit(0.0)).otherwise(F.stddev_samp(y)).alias("std"),
        )
        return local if asked is None else asked.join(local, left, "left")
    centre = global_moments(obs, node.attr)
    placed = with_position(obs, node).withColumn("_g", centre)
    points = moment_points(placed, left, POS, node.attr, F.col("_g.m"))
    radius = grid_radius(node.band.radius)
    if asked is None:
        merged = band_moments(points, None, left, POS, radius, n_places=sketch(placed, [[POS]])[1][0])
    else:
        merged = band_moments(cut(points), asked.select(*left, POS).distinct(), left, POS, radius)
    merged = merged.withColumn("_g", centre)
    mean, std = mean_std(F.col("_g.m"))
    return merged.select(*left, POS, "n", mean.alias("mean"), std.alias("std"))


def numeric_density(node: Node, x: Column, mean: Column, std: Column) -> Column:
    fn = dist.half_normal if node.greater_zero else dist.normal
    return fn(x.cast("double"), mean, std)
