"""Parent matching that drops, left to right, each parent that would leave no row.

Scoring a table against itself never needs this: a row matches itself. New rows and repair
candidates may ask for combinations that were not observed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cpdspark.functions.lineage import cut
from cpdspark.operators import cpd
from cpdspark.operators.bands import band_counts, grid_radius, mean_std, merge_moments, moment_points
from cpdspark.operators.counts import domain_size
from cpdspark.operators.cpd import POS, fallback_to_whole, global_moments, lookup_keys, with_position
from cpdspark.plans.spec import Node

KEY = "_relaxed"
MASK = "_mask"


class _Order:
    """Parents in the order of the model; bit i of a mask keeps parent i."""

    def __init__(self, node: Node):
        self.names = [p.attr for p in node.parents]
        self.band = next((i for i, p in enumerate(node.parents) if p is node.band), None)
        self.band_bit = 0 if self.band is None else 1 << self.band
        self.pos = [] if self.band is None else [POS]

    def columns(self, upto: int) -> list[str]:
        return [c for i, c in enumerate(self.names[:upto]) if i != self.band]

    def key(self, mask: Column, upto: int | None = None) -> Column:
        """One text key for the equality parents kept by a mask; the band goes by its position."""
        upto = len(self.names) if upto is None else upto
        kept = [
            F.when(mask.bitwiseAND(1 << i) != 0, F.col(c).cast("string")).alias(str(i))
            for i, c in enumerate(self.names[:upto])
            if i != self.band
        ]
        return F.to_json(F.struct(mask.alias("m"), *kept))


def keep_matching(obs: DataFrame, node: Node, asked: DataFrame) -> DataFrame:
    """Asked tuples with ``_mask`` and ``_relaxed``, the kept parents and their key.

    ``obs`` and ``asked`` have the parents, and the position of a band. Whether a combination
    exists is looked up among the observed combinations of the parents so far.
    """
    order = _Order(node)
    tuples = cut(obs.select(*order.columns(len(order.names)), *order.pos).distinct())
    state = asked.withColumn(MASK, F.lit(0))
    for i in range(len(order.names)):
        state = state.withColumn("_trial", F.col(MASK).bitwiseOR(F.lit(1 << i)))
        state = state.withColumn(KEY, order.key(F.col("_trial"), i + 1))
        masks = [m | 1 << i for m in range(1 << i)]
        plain = [m for m in masks if not m & order.band_bit]
        banded = [m for m in masks if m & order.band_bit]
        found = []
        if plain:
            known = _observed_keys(tuples, order, plain, i + 1).select(KEY).distinct()
            found.append(("_plain", known.withColumn("_plain", F.lit(True)), [KEY]))
        if banded:
            places = _observed_keys(tuples, order, banded, i + 1).select(KEY, POS).distinct()
            wanted = state.filter(F.col("_trial").bitwiseAND(F.lit(order.band_bit)) != 0).select(KEY, POS).distinct()
            near = band_counts(
                places.withColumn("n", F.lit(1).cast("long")), wanted, [KEY], POS, grid_radius(node.band.radius)
            )
            found.append(("_banded", near.select(KEY, POS, (F.col("n") > 0).alias("_banded")), [KEY, POS]))
        ok = F.lit(False)
        for flag, table, on in found:
            state = state.join(table, on, "left")
            ok = ok | F.coalesce(F.col(flag), F.lit(False))
        kept = F.when(ok, F.col("_trial")).otherwise(F.col(MASK))
        state = state.withColumn(MASK, kept).drop("_trial", KEY, *[f[0] for f in found])
        state = cut(state) if banded else state
    return cut(state.withColumn(KEY, order.key(F.col(MASK))))


def _observed_keys(tuples: DataFrame, order: _Order, masks: list[int], upto: int) -> DataFrame:
    part = tuples.select(*order.columns(upto), *order.pos).distinct()
    unfolded = part.withColumn("_m", F.explode(F.array(*[F.lit(m) for m in masks])))
    return unfolded.withColumn(KEY, order.key(F.col("_m"), upto))


def expanded(df: DataFrame, node: Node, places: DataFrame) -> DataFrame:
    """Observed tuples once per mask that some asked tuple kept."""
    masks = places.select(MASK).distinct().agg(F.collect_list(MASK)).scalar()
    unfolded = df.withColumn("_masks", masks).withColumn("_m", F.explode("_masks")).drop("_masks")
    return unfolded.withColumn(KEY, _Order(node).key(F.col("_m"))).drop("_m")


def split(places: DataFrame, node: Node) -> tuple[DataFrame, DataFrame]:
    """Places that kept the band, and the others."""
    bit = F.lit(_Order(node).band_bit)
    kept = F.col(MASK).bitwiseAND(bit) != 0
    return places.filter(kept), places.filter(~kept)


def categorical(obs: DataFrame, node: Node, asked: DataFrame) -> DataFrame:
    """As :func:`cpdspark.operators.cpd.categorical`, on the parents that can be kept."""
    keys, v = lookup_keys(node), node.attr
    rows = with_position(obs, node)
    places = keep_matching(rows, node, asked.select(*keys).distinct())
    banded, plain = split(places, node)
    joint = rows.groupBy(*keys, v).agg(F.count(F.lit(1)).alias("c"))
    counted = expanded(joint, node, plain).groupBy(KEY, v).agg(F.sum("c").alias("c"))
    total = counted.groupBy(KEY).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("seen"))
    base = asked.join(plain, keys).join(counted, [KEY, v], "left").join(total, KEY, "left")
    base = base.select(*keys, v, "c", "total", "seen")
    if node.band:
        columns = [*[k for k in keys if k != POS], node.band.attr, v]
        wanted = asked.join(banded, keys)
        points = cpd.band_points(expanded(obs.select(*columns), node, banded), node, [KEY])
        counts = cpd.band_value_counts(points, node, [KEY], wanted.select(KEY, POS, v).distinct())
        near = wanted.join(counts, [KEY, POS, v]).select(*keys, v, "c", "total", "seen")
        base = base.unionByName(near)
    return cpd.smoothed(base, [*keys, v], domain_size(obs, v))


def numerical(obs: DataFrame, node: Node, asked: DataFrame) -> DataFrame:
    """As :func:`cpdspark.operators.cpd.numerical`, on the parents that can be kept."""
    keys, y = lookup_keys(node), node.attr
    rows = with_position(obs, node)
    places = keep_matching(rows, node, asked.select(*keys).distinct())
    banded, plain = split(places, node)
    centre = global_moments(obs, y)
    points = moment_points(rows.withColumn("_g", centre), keys[:-1], keys[-1], y, F.col("_g.m"))
    merged = expanded(points, node, plain).groupBy(KEY).agg(*merge_moments()).withColumn("_g", centre)
    mean, std = mean_std(F.col("_g.m"))
    stats = plain.join(merged.select(KEY, "n", mean.alias("mean"), std.alias("std")), KEY, "left")
    stats = stats.select(*keys, "n", "mean", "std")
    if node.band:
        columns = [*[k for k in keys if k != POS], node.band.attr, y]
        near = cpd.numerical_matches(
            expanded(obs.select(*columns), node, banded), node, [KEY], banded.select(KEY, POS).distinct()
        )
        stats = stats.unionByName(banded.join(near, [KEY, POS]).select(*keys, "n", "mean", "std"))
    return fallback_to_whole(stats, keys, centre)
