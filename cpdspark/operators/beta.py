"""Older estimators: Beta-weighted occurrence and dependencies, and numeric dependencies.

In ``mean`` mode a Beta weight is its expectation, so results are exact. In ``sample`` mode it is
drawn per distinct value from the counter-based generator, so results are reproducible.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cpdspark.functions import distributions as dist
from cpdspark.functions.gamma import beta_draws
from cpdspark.operators.counts import domain_size


def _beta(df: DataFrame, a: Column, total: Column, name: str, mode: str, seed: int, key: list[str]) -> DataFrame:
    """Add a Beta(a, total - a) weight. With no mass on the other side it is 1."""
    if mode == "mean":
        return df.withColumn(name, dist.safe_div(a.cast("double"), total.cast("double")))
    if mode != "sample":
        raise ValueError("mode must be 'mean' or 'sample'")
    state = F.xxhash64(F.lit(f"{seed}{name}"), *[F.col(k).cast("string") for k in key])

    @F.pandas_udf("double")
    def draw(alpha: pd.Series, other: pd.Series, states: pd.Series) -> pd.Series:
        return pd.Series(beta_draws(alpha.to_numpy(), other.to_numpy(), states.to_numpy().view("u8")))

    return df.withColumn(name, draw(a.cast("double"), (total - a).cast("double"), state))


def occurrence(df: DataFrame, attr: str, mode: str = "mean", seed: int = 0) -> DataFrame:
    """``attr, prob``: weight Beta(n_v, n - n_v) per value, normalised."""
    counts = df.groupBy(attr).agg(F.count(F.lit(1)).alias("n")).dropna()
    sized = counts.withColumn("_total", counts.agg(F.sum("n")).scalar())
    weighted = _beta(sized, F.col("n"), F.col("_total"), "weight", mode, seed, [attr])
    total = weighted.agg(F.sum("weight")).scalar()
    return weighted.withColumn("_w", total).select(attr, dist.safe_div(F.col("weight"), F.col("_w")).alias("prob"))


def _dependency(
    df: DataFrame,
    left: list[str],
    right: str,
    seen_count: Column,
    unseen_count: Column,
    care_global: bool,
    mode: str,
    seed: int,
) -> DataFrame:
    """``left..., right, prob`` for seen pairs, plus ``unseen_prob``, the probability of any other value.

    Unseen values of a left side have equal local counts; they are summed in closed form without
    the global factor, and by complement of the global weights with it.
    """
    rows = df.select(*left, right).dropna()
    pairs = rows.groupBy(*left, right).agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.withColumn("_d", domain_size(rows, right))
    pairs = pairs.withColumn("_seen_count", seen_count.cast("double"))
    per_left = pairs.groupBy(*left).agg(
        F.sum("_seen_count").alias("_s"), F.count(F.lit(1)).alias("_k"), F.first("_d").alias("_dd")
    )
    per_left = per_left.withColumn("_low", unseen_count.cast("double"))
    per_left = per_left.withColumn("_total", F.col("_s") + (F.col("_dd") - F.col("_k")) * F.col("_low"))
    both = pairs.join(per_left, left)
    both = _beta(both, F.col("_seen_count"), F.col("_total"), "_local", mode, seed, [*left, right])
    if care_global:
        whole = rows.groupBy(right).agg(F.count(F.lit(1)).alias("_g"))
        whole = whole.withColumn("_n", whole.agg(F.sum("_g")).scalar())
        whole = _beta(whole, F.col("_g"), F.col("_n"), "_global", mode, seed, [right])
        both = both.join(whole.select(right, "_global"), right).withColumn("_w", F.col("_local") * F.col("_global"))
        both = both.withColumn("_gsum", whole.agg(F.sum("_global")).scalar())
    else:
        both = both.withColumn("_global", F.lit(1.0)).withColumn("_w", F.col("_local"))
        both = both.withColumn("_gsum", F.col("_dd").cast("double"))
    rest = F.first("_gsum") - F.sum("_global")
    low_weight = dist.safe_div(F.first("_low"), F.first("_total"))
    norm = both.groupBy(*left).agg(
        (F.sum("_w") + F.when(F.first("_dd") > F.first("_k"), rest * low_weight).otherwise(0.0)).alias("_norm"),
        F.when(F.first("_dd") > F.first("_k"), low_weight).alias("_unseen"),
    )
    return both.join(norm, left).select(
        *left,
        right,
        dist.safe_div(F.col("_w"), F.col("_norm")).alias("prob"),
        dist.safe_div(F.col("_unseen"), F.col("_norm")).alias("unseen_prob"),
    )


def functional_dependency(
    df: DataFrame, left: str, right: str, care_global: bool = False, mode: str = "mean", seed: int = 0
) -> DataFrame:
    """One parent: local count with floor 1, optionally times the global weight.

    With ``care_global`` the probability of an unseen value is ``unseen_prob`` times its global
    weight. In ``sample`` mode unseen values keep their expectation.
    """
    return _dependency(df, [left], right, F.col("n"), F.lit(1), care_global, mode, seed)


def co_occurrence(
    df: DataFrame,
    left: list[str],
    right: str,
    care_global: bool = False,
    mode: str = "mean",
    seed: int = 0,
    counted: bool = False,
) -> DataFrame:
    """Many parents: a fixed high score for seen values and a low one for others.

    Low is ``ln D`` and high ``10 D ln D``; with ``counted`` they are 1 and 100 times the count.
    """
    if counted:
        return _dependency(df, left, right, F.col("n") * 100, F.lit(1), care_global, mode, seed)
    d = F.col("_d").cast("double")
    high = F.ln(d) * d * 10
    return _dependency(df, left, right, high, F.ln(F.col("_dd").cast("double")), care_global, mode, seed)


def numerical_dependency(
    df: DataFrame, left: list[str], right: str, care_global: bool = False, lone_std: float = 1.0
) -> DataFrame:
    """``left..., n, mean, std``: local moments, a fixed deviation where it is undefined, and with
    ``care_global`` the average with the whole table's.
    """
    y = F.col(right).cast("double")
    rows = df.select(*left, right).dropna()
    local = rows.groupBy(*left).agg(
        F.count(F.lit(1)).alias("n"), F.avg(y).alias("mean"), F.coalesce(F.stddev_samp(y), F.lit(lone_std)).alias("std")
    )
    if not care_global:
        return local
    whole = rows.agg(F.struct(F.avg(y).alias("m"), F.coalesce(F.stddev_samp(y), F.lit(lone_std)).alias("s"))).scalar()
    return local.withColumn("_g", whole).select(
        *left,
        "n",
        ((F.col("mean") + F.col("_g.m")) / 2).alias("mean"),
        ((F.col("std") + F.col("_g.s")) / 2).alias("std"),
    )


def dependency_ensemble(
    df: DataFrame, lefts: list[list[str]], right: str, floor: float = 0.0001
) -> DataFrame:
    """Rows with the mean of several dependencies' suggestions and their spread as deviation.

    Each suggestion is the dependency's mean. ``lp`` is the half normal log density of the value.
    """
    out = df
    names = []
    for i, left in enumerate(lefts):
        means = numerical_dependency(df, left, right).select(*left, F.col("mean").alias(f"_m{i}"))
        out = out.join(means, left)
        names.append(F.col(f"_m{i}"))
    m = len(names)
    mean = reduce(lambda a, b: a + b, names) / m
    squares = reduce(lambda a, b: a + b, [(c - mean) * (c - mean) for c in names])
    std = F.greatest(F.sqrt(squares / (m - 1)), F.lit(floor))
    with_both = out.withColumn("ens_mean", mean).withColumn("ens_std", std)
    density = dist.half_normal(F.col(right).cast("double"), F.col("ens_mean"), F.col("ens_std"))
    return with_both.withColumn("lp", density).drop(*[f"_m{i}" for i in range(m)])


def source_mixture(
    df: DataFrame, a: str, b: str, target: str, lone_std: float = 0.5
) -> DataFrame:
    """Rows with ``lp``, the log density of a mixture of three normals: given a, given b, given both.

    The first two weigh as often as their values occur; the joint one has half of the mass.
    """
    y = F.col(target).cast("double")

    def moments(keys: list[str], tag: str) -> DataFrame:
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"_n{tag}"),
            F.avg(y).alias(f"_m{tag}"),
            F.coalesce(F.stddev_samp(y), F.lit(lone_std)).alias(f"_s{tag}"),
        )

    out = df.join(moments([a], "a"), [a]).join(moments([b], "b"), [b]).join(moments([a, b], "ab"), [a, b])
    total = F.col("_na") + F.col("_nb")
    weights = {"a": F.col("_na") / (2 * total), "b": F.col("_nb") / (2 * total), "ab": F.lit(0.5)}
    parts = [F.ln(w) + dist.normal(y, F.col(f"_m{t}"), F.col(f"_s{t}")) for t, w in weights.items()]
    parts = [F.when(F.isnan(p), dist.neg_inf()).otherwise(p) for p in parts]
    lp = dist.log_sum_exp(parts)
    return out.withColumn("lp", lp).drop(*[f"_{k}{t}" for k in "nms" for t in weights])


def population_prior(dim: DataFrame, group: str, item: str, size: str) -> DataFrame:
    """Share of each group by size, and of each item within its group."""
    items = dim.groupBy(group, item).agg(F.sum(size).alias("_i"))
    groups = items.groupBy(group).agg(F.sum("_i").alias("_g"))
    whole = groups.agg(F.sum("_g")).scalar()
    return (
        items.join(groups, group)
        .withColumn("_w", whole)
        .select(
            group,
            item,
            dist.safe_div(F.col("_g"), F.col("_w")).alias("group_share"),
            dist.safe_div(F.col("_i"), F.col("_g")).alias("item_share"),
        )
    )
