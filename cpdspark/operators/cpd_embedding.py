"""Conditional distributions that borrow the nearest rows where a combination is rare.

Rows equal in all soft parents (and inside the band) are hits. A combination with fewer than k
hits is filled up to k with the nearest other rows inside the band that are equal in the hard
parents. Hard parents restrict the borrowed rows only; they play no part in what is a hit.

Frequent combinations take the aggregate path of :mod:`cpdspark.operators.cpd`. Only rare ones
reach the neighbour search, with at most k candidate rows per distinct combination.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cpdspark.functions.lineage import cut
from cpdspark.operators import cpd
from cpdspark.operators.bands import grid_radius
from cpdspark.operators.counts import domain_size
from cpdspark.operators.cpd import POS, with_position
from cpdspark.operators.cumulative import chunks_for, running_totals, totals_at
from cpdspark.operators.knn import nearest, with_vectors
from cpdspark.plans.spec import Node, Role

PLACE = "_place"


class _Parts:
    def __init__(self, node: Node):
        self.soft = node.by_role(Role.SOFT)
        self.exact = node.by_role(Role.CAT)
        self.hard = node.by_role(Role.HARD)
        self.pos = [POS] if node.band else []
        self.hit = self.soft + self.exact + self.pos
        self.all = self.soft + self.exact + self.hard + self.pos


def members_of_rare(obs: DataFrame, rare: DataFrame, node: Node, emb: DataFrame, id_col: str) -> DataFrame:
    """Hit and borrowed rows of rare combinations: ``_place, cid, _target``, at most k each.

    ``rare`` holds the distinct parents with ``n``, their number of hits.
    """
    p, target = _Parts(node), node.attr
    radius = grid_radius(node.band.radius) if node.band else 0
    asked = rare.withColumn(PLACE, F.to_json(F.struct(*p.all)))
    rows = with_position(obs, node).select(*p.all, F.col(id_col).alias("cid"), F.col(target).alias("_target"))
    first_k = Window.partitionBy(*p.all).orderBy("cid")
    few = cut(rows.withColumn("_i", F.row_number().over(first_k)).filter(F.col("_i") <= node.k).drop("_i"))

    with_hits = asked.filter("n > 0")
    if node.band:
        hits = _hits_in_band(few, with_hits, p.soft + p.exact, radius)
    else:
        hits = with_hits.select(*p.hit, PLACE).join(few, p.hit).select(PLACE, "cid", "_target")

    lacking = with_vectors(asked.withColumn("qid", F.col(PLACE)), emb, p.soft)
    borrowed = nearest(
        lacking,
        with_vectors(few, emb, p.soft),
        p.soft,
        block=p.exact + p.hard,
        need=F.lit(node.k) - F.col("n"),
        pos=POS if node.band else None,
        radius=radius,
        payload=["_target"],
    ).select(F.col("qid").alias(PLACE), "cid", "_target")
    return cut(hits.unionByName(borrowed))


def _hits_in_band(few: DataFrame, places: DataFrame, keys: list[str], radius: int) -> DataFrame:
    """Rows inside the band of each place: in band order they are ``n`` neighbouring numbers.

    The first number is the count of rows below the band, so that places and rows meet by number
    and never as all pairs of a key.
    """
    chunks = chunks_for(few)
    rows = few.select(*keys, F.struct(POS, "cid").alias("_at"), "cid", "_target", F.lit(1).cast("long").alias("_i"))
    numbered = running_totals(rows, keys, "_at", {"_i": "sum"}, chunks).select(*keys, "_i", "cid", "_target")
    counts = few.groupBy(*keys, POS).agg(F.count(F.lit(1)).alias("_below"))
    lower = places.select(*keys, PLACE, "n", (F.col(POS) - radius - 1).alias(POS))
    first = totals_at(counts, lower, keys, POS, {"_below": "sum"}, chunks)
    wanted = first.select(*keys, PLACE, F.explode(F.sequence(F.col("_below") + 1, F.col("_below") + F.col("n"))).alias("_i"))
    return wanted.join(numbered, [*keys, "_i"]).select(PLACE, "cid", "_target")


def numerical(
    obs: DataFrame, node: Node, emb: DataFrame, id_col: str, asked: DataFrame | None = None
) -> DataFrame:
    """Mean and deviation per parents, on hits and borrowed rows."""
    p = _Parts(node)
    whole = cpd.global_moments(obs, node.attr)
    places = (with_position(obs, node) if asked is None else asked).select(*p.all).distinct()
    matches = cpd.numerical_matches(obs, node, p.soft + p.exact, places.select(*p.hit).distinct())
    if _never_rare(node, asked):
        return cpd.fallback_to_whole(places.join(matches, p.hit), p.all, whole)
    counted = cut(places.join(matches, p.hit, "left").withColumn("n", F.coalesce("n", F.lit(0))))
    dense = counted.filter(F.col("n") >= node.k).select(*p.all, "n", "mean", "std")
    rare = counted.filter(F.col("n") < node.k).select(*p.all, "n")
    if rare.isEmpty():
        return cpd.fallback_to_whole(dense, p.all, whole)
    y = F.col("_target").cast("double")
    stats = members_of_rare(obs, rare, node, emb, id_col).groupBy(PLACE).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(y).alias("mean"),
        F.when(F.min(y) == F.max(y), F.lit(0.0)).otherwise(F.stddev_samp(y)).alias("std"),
    )
    filled = rare.drop("n").withColumn(PLACE, F.to_json(F.struct(*p.all))).join(stats, PLACE, "left").drop(PLACE)
    return cpd.fallback_to_whole(dense.unionByName(filled), p.all, whole)


def categorical(
    obs: DataFrame, node: Node, emb: DataFrame, id_col: str, asked: DataFrame | None = None
) -> DataFrame:
    """Log probability per (parents, value), on hits and borrowed rows."""
    p, v = _Parts(node), node.attr
    tuples = (with_position(obs, node) if asked is None else asked).select(*p.all, v).distinct()
    hit_tuples = tuples.select(*p.hit, v).distinct()
    if node.band:
        joint = cpd.band_points(obs, node, p.soft + p.exact)
        counts = cpd.band_value_counts(joint, node, p.soft + p.exact, hit_tuples)
    else:
        joint = cut(obs.groupBy(*p.hit, v).agg(F.count(F.lit(1)).alias("c")))
        total = joint.groupBy(*p.hit).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("seen"))
        counts = hit_tuples.join(joint, [*p.hit, v], "left").join(total, p.hit, "left")
    counted = tuples.join(counts, [*p.hit, v], "left").withColumn("total", F.coalesce("total", F.lit(0)))
    size = domain_size(joint, v)
    if _never_rare(node, asked):
        return cpd.smoothed(counted, [*p.all, v], size)
    counted = cut(counted)
    dense = counted.filter(F.col("total") >= node.k).select(*p.all, v, "c", "total", "seen")
    rare_tuples = counted.filter(F.col("total") < node.k)
    rare = rare_tuples.select(*p.all, F.col("total").alias("n")).distinct()
    if rare.isEmpty():
        return cpd.smoothed(dense, [*p.all, v], size)
    mine = members_of_rare(obs, rare, node, emb, id_col).groupBy(PLACE, "_target").agg(F.count(F.lit(1)).alias("c"))
    mine_total = mine.groupBy(PLACE).agg(F.sum("c").alias("total"), F.count(F.lit(1)).alias("seen"))
    filled = (
        rare_tuples.select(*p.all, v, F.to_json(F.struct(*p.all)).alias(PLACE))
        .join(mine.withColumnRenamed("_target", v), [PLACE, v], "left")
        .join(mine_total, PLACE, "left")
        .drop(PLACE)
    )
    return cpd.smoothed(dense.unionByName(filled), [*p.all, v], size)


def _never_rare(node: Node, asked: DataFrame | None) -> bool:
    """With k = 1 a table that asks about itself never borrows: each row is its own hit."""
    return node.k == 1 and asked is None
