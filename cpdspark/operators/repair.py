"""Better values for a suspect cell: exact ranking, proposals, and sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cpdspark.functions.distributions import neg_inf
from cpdspark.functions.lineage import cut
from cpdspark.functions.rng import gumbel, tagged
from cpdspark.operators.counts import domain
from cpdspark.operators.cumulative import global_rank
from cpdspark.operators.draws import NEVER, SEEN, draw, seen_values
from cpdspark.operators.knn import value_neighbours
from cpdspark.operators.score import lp, score
from cpdspark.plans.spec import Kind, ModelSpec, Role

NEAR_WEIGHT = 5.0  # fixed value: weight of a near value; any other has weight 1


def candidates(suspects: DataFrame, obs: DataFrame, id_col: str, attr: str) -> DataFrame:
    """Each suspect once per value of the attribute; ``present`` keeps its own value.

    Suspects are few (the k least probable rows). Values are handed out by number: each suspect
    unfolds into the numbers of the domain, which join the numbered values, so that both sides
    are spread over tasks.
    """
    numbered = cut(global_rank(domain(obs, attr), attr, "_rank"))
    size = numbered.agg(F.count(F.lit(1))).scalar()
    unfolded = suspects.withColumnRenamed(attr, "present").withColumn("_size", size)
    unfolded = unfolded.withColumn("_rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_size") - 1)))
    return unfolded.join(numbered, "_rank").drop("_rank", "_size")


def _equal_keys(spec: ModelSpec, attr: str) -> list[list[str]] | None:
    """For each node that involves the attribute, the other parents that must be equal; None if a value that was
    never seen with them could still matter (borrowed neighbours, dropped parents, frequencies, bands on it)."""
    keys = []
    for n in spec.touching(attr):
        if n.kind is Kind.UNIFORM:
            continue
        others = [p for p in n.by_role(Role.CAT) if p != attr]
        if n.kind not in (Kind.CAT, Kind.NUM) or not n.strict or not others or (n.band and n.band.attr == attr):
            return None
        keys.append(others)
    return keys or None


def candidate_classes(
    suspects: DataFrame, obs: DataFrame, spec: ModelSpec, id_col: str, attr: str, top: int
) -> DataFrame | None:
    """Suspects with the values that something supports, and the first ``top`` of all others.

    A value is supported if it was seen with the equal parents of some node that involves the attribute. To all
    others every node gives its default, the same for each, so they are one class: its first ``top`` values are
    listed, and the very first carries the class's size in ``times`` (the next ones 0; a supported value 1). So
    a suspect takes as many rows as there are seen combinations, not as there are values. None where the
    model does not allow this.
    """
    keys = _equal_keys(spec, attr)
    if keys is None:
        return None
    value, key = F.col(attr).cast("string").alias("value"), F.col(id_col).cast("string").alias("key")
    asked = cut(suspects.withColumn("key", key))
    met = asked.select("key", value)  # its own value
    for equal in keys:
        seen_with = obs.select(*equal, value).distinct()
        met = met.unionByName(asked.select("key", *equal).join(seen_with, equal).select("key", "value"))
    everywhere = domain(obs, attr).select(F.lit(attr).alias("attr"), F.lit("").alias("key"), value, F.lit(1).cast("long").alias("n"))
    known = met.distinct().join(everywhere.select("value"), "value", "left_semi")
    pairs = known.select(F.lit(attr).alias("attr"), "key", "value", F.lit(1).cast("long").alias("n"))
    seen = seen_values(everywhere.unionByName(pairs))
    size = seen.numbered.agg(F.count(F.lit(1))).scalar()
    sized = asked.select("key").join(seen.sizes.select("key", "n_never"), "key", "left").withColumn("_all", size)
    sized = sized.withColumn("_m", F.coalesce("n_never", "_all")).filter("_m > 0")
    cells = sized.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("_m"), F.lit(top)) - 1))).select(
        F.col("key").alias("_suspect_key"),
        F.when(F.col("i") == 0, F.col("_m")).otherwise(F.lit(0)).cast("long").alias("times"),
        F.lit(attr).alias("attr"),
        F.when(F.col("n_never").isNull(), "").otherwise(F.col("key")).alias("key"),
        F.when(F.col("n_never").isNull(), SEEN).otherwise(NEVER).alias("mode"),
        ((F.col("i") + 0.5) / F.col("_m")).alias("u"),  # the i-th
    )
    rest = draw(cells, seen).select(F.col("_suspect_key").alias("key"), "value", "times")
    listed = known.select("key", "value", F.lit(1).cast("long").alias("times")).unionByName(rest)
    out = asked.withColumnRenamed(attr, "present").join(listed, "key").withColumn(attr, F.col("value").cast(obs.schema[attr].dataType))
    return out.drop("key", "value")


def _joint(
    obs: DataFrame, spec: ModelSpec, id_col: str, attr: str, rows: DataFrame, emb: DataFrame | None
) -> DataFrame:
    """``log_joint`` of candidate rows up to a constant per suspect: only nodes that involve the attribute.

    Where all matches of a candidate have the same number, only that number has mass (``point_mass``).
    NaN is left only where the whole table has a single value; it then says nothing and counts as 0.
    """
    touching = [n.attr for n in spec.touching(attr)]
    more = [c for c in rows.columns if c == "times"]
    keyed = rows.withColumn("_suspect", F.col(id_col))
    scored = score(obs, spec, id_col, emb, rows=keyed, keep=["_suspect", "present", *more], only=touching, point_mass=True)
    nan_safe = sum(
        (F.when(F.isnan(lp(a)), F.lit(0.0)).otherwise(F.col(lp(a))) for a in touching), F.lit(0.0)
    )
    return scored.withColumn("log_joint", nan_safe)


def repair_exact(
    suspects: DataFrame,
    obs: DataFrame,
    spec: ModelSpec,
    id_col: str,
    attr: str,
    top: int,
    emb: DataFrame | None = None,
) -> DataFrame:
    """The ``top`` most probable values per suspect: ``id, present, <attr>, posterior, rank``.

    Values that nothing supports are scored as one class (``candidate_classes``). Models in which an unseen value
    may borrow or drop something unfold the domain for each suspect. The posterior's total is added up before
    the shuffle, and the ranking keeps ``top`` rows before it, so no window holds a domain.
    """
    rows = candidate_classes(suspects.select(id_col, *spec.attrs), obs, spec, id_col, attr, top)
    if rows is None:
        rows = candidates(suspects.select(id_col, *spec.attrs), obs, id_col, attr).withColumn("times", F.lit(1).cast("long"))
    joint = cut(_joint(obs, spec, id_col, attr, cut(rows), emb))
    best = joint.groupBy(id_col).agg(F.max("log_joint").alias("_best"))
    mass = F.when(F.col("_best") == neg_inf(), F.lit(1.0)).otherwise(F.exp(F.col("log_joint") - F.col("_best")))
    totals = joint.join(best, id_col).groupBy(id_col, "_best").agg(F.sum(mass * F.col("times")).alias("_total"))
    order = Window.partitionBy(id_col).orderBy(F.desc("log_joint"), F.asc(attr))
    ranked = joint.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    posterior = F.when(F.col("_total") > 0, mass / F.when(F.col("_total") > 0, F.col("_total"))).otherwise(F.lit(0.0))
    return ranked.join(totals, id_col).select(id_col, "present", attr, "log_joint", posterior.alias("posterior"), "rank")


def proposal(values: DataFrame, k: int, sources: DataFrame | None = None) -> DataFrame:
    """Proposal per source value: its k nearest values weigh five times as much as all others.

    ``values`` is (attr, value, vec) of one or more attributes; ``sources`` (attr, value) are the values
    asked for, by default all. Gives ``attr, value, candidate, n, weight, prob``: a row for each near value,
    and one with a null candidate for the ``n`` others together, the source itself among them, which
    all have the same weight and probability. So a source takes k + 1 rows, whatever its domain.
    """
    near = value_neighbours(values, k, sources).select("attr", "value", F.col("neighbour").alias("candidate"))
    asked = values.select("attr", "value") if sources is None else sources.select("attr", "value").distinct()
    sizes = values.groupBy("attr").agg(F.countDistinct("value").alias("_size"))
    found = near.groupBy("attr", "value").agg(F.count(F.lit(1)).alias("_near"))
    counted = cut(asked.join(sizes, "attr").join(found, ["attr", "value"], "left").na.fill(0, ["_near"]))
    one = F.lit(1).cast("long")
    heavy = near.join(counted, ["attr", "value"]).select("*", one.alias("n"), F.lit(NEAR_WEIGHT).alias("weight"))
    rest = counted.select("*", F.lit(None).cast("string").alias("candidate"), (F.col("_size") - F.col("_near")).alias("n"), F.lit(1.0).alias("weight"))
    total = F.col("_near") * NEAR_WEIGHT + (F.col("_size") - F.col("_near"))
    both = heavy.unionByName(rest.filter("n > 0"))
    return both.select("attr", "value", "candidate", "n", "weight", (F.col("weight") / total).alias("prob"))


def repair_sampled(
    suspects: DataFrame,
    obs: DataFrame,
    spec: ModelSpec,
    id_col: str,
    attr: str,
    emb: DataFrame,
    k: int,
    particles: int,
    seed: int,
) -> DataFrame:
    """Importance resampling: propose ``particles`` values per suspect, weigh by joint over proposal,
    and draw one: ``id, present, <attr>, log_weight``.
    """
    values = emb.filter(F.col("attr") == attr).join(
        domain(obs, attr).select(F.col(attr).cast("string").alias("value")), "value", "left_semi"
    )
    numbered = cut(global_rank(values.select("value"), "value", "_rank"))
    near = value_neighbours(values, k, suspects.select(F.lit(attr).alias("attr"), F.col(attr).cast("string").alias("value")))
    near = near.join(numbered.select(F.col("value").alias("neighbour"), "_rank"), "neighbour")
    # At most k neighbours per value, so these arrays are small.
    near = near.groupBy("value").agg(F.array_sort(F.collect_list("_rank")).alias("_near"))
    size = numbered.agg(F.count(F.lit(1))).scalar()
    drawn = (
        suspects.select(id_col, *spec.attrs)
        .withColumnRenamed(attr, "present")
        .withColumn("value", F.col("present").cast("string"))
        .join(near, "value", "left")
        .withColumn("_near", F.coalesce("_near", F.array().cast("array<bigint>")))
        .withColumn("_size", size)
        .withColumn("_particle", F.explode(F.sequence(F.lit(1), F.lit(particles))))
    )
    m = F.size("_near")
    heavy = m * F.lit(NEAR_WEIGHT)
    total = heavy + (F.col("_size") - m)
    at = tagged(seed, "particle", id_col, "_particle") * total
    rest = F.least((at - heavy).cast("long"), F.col("_size") - m - 1)
    near_rank = F.get(F.col("_near"), F.least(F.floor(at / NEAR_WEIGHT), m - 1).cast("int"))
    drawn = drawn.withColumn("_at", at).withColumn("_is_near", F.col("_at") < heavy).withColumn("_rest", rest)
    # Below the n-th other value lie the near ones with r_i - i <= n.
    below = F.size(F.filter(F.transform("_near", lambda r, i: r - i), lambda g: g <= F.col("_rest")))
    drawn = drawn.withColumn("_rank", F.when(F.col("_is_near"), near_rank).otherwise(F.col("_rest") + below))
    weight = F.when(F.col("_is_near"), F.lit(NEAR_WEIGHT)).otherwise(F.lit(1.0))
    drawn = drawn.withColumn("_log_q", F.ln(weight / total)).drop("value", "_near")
    chosen = drawn.join(numbered, "_rank").withColumn(attr, F.col("value").cast(obs.schema[attr].dataType))
    chosen = cut(chosen.select(id_col, *spec.attrs, "present", "_particle", "_log_q"))
    distinct = chosen.drop("_particle").distinct()
    joint = _joint(obs, spec, id_col, attr, distinct.drop("_log_q"), emb).select(id_col, attr, "log_joint")
    weighted = chosen.join(joint, [id_col, attr]).withColumn("log_weight", F.col("log_joint") - F.col("_log_q"))
    noise = gumbel(tagged(seed, "resample", id_col, "_particle"))
    return weighted.groupBy(id_col).agg(
        F.max_by(F.struct("present", attr, "log_weight"), F.col("log_weight") + noise).alias("_w")
    ).select(id_col, "_w.*")
