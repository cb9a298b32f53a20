"""Domains, frequencies, co-occurrence and conditional moments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cpdspark.functions.distributions import safe_div
from cpdspark.functions.lineage import cut
from cpdspark.operators.cumulative import global_rank, with_previous


def domain(df: DataFrame, attr: str) -> DataFrame:
    return df.select(attr).filter(F.col(attr).isNotNull()).distinct()


def domain_size(df: DataFrame, attr: str) -> Column:
    """Exact number of distinct values, as a scalar to use in other plans."""
    return df.select(attr).distinct().agg(F.count(attr)).scalar()


def frequency(df: DataFrame, *attrs: str) -> DataFrame:
    """Occurrences and share of every distinct value or combination."""
    counts = df.groupBy(*attrs).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / df.agg(F.count(F.lit(1))).scalar())


def co_occurrence(df: DataFrame, left: list[str], right: str) -> DataFrame:
    return df.groupBy(*left, right).agg(F.count(F.lit(1)).alias("n"))


def collected(df: DataFrame, key: str, attr: str) -> DataFrame:
    """Co-occurring values per key with their multiplicity, one row per (key, value).

    The list with duplicates of a frequent key would not fit a task; the counted form holds the
    same content for keys of any size.
    """
    return co_occurrence(df, [key], attr)


def conditional_moments(df: DataFrame, left: list[str], target: str) -> DataFrame:
    """Mean and sample deviation per combination; the whole table's where only one row matches."""
    whole = df.agg(F.struct(F.avg(target).alias("m"), F.stddev_samp(target).alias("s"))).scalar()
    local = df.groupBy(*left).agg(
        F.count(F.lit(1)).alias("n"), F.avg(target).alias("_m"), F.stddev_samp(target).alias("_s")
    )
    lone = F.col("n") <= 1
    return local.withColumn("_g", whole).select(
        *left,
        "n",
        F.when(lone, F.col("_g.m")).otherwise(F.col("_m")).alias("mean"),
        F.when(lone, F.col("_g.s")).otherwise(F.col("_s")).alias("std"),
    )


def support(df: DataFrame, attr: str) -> DataFrame:
    return df.agg(F.min(attr).alias("low"), F.max(attr).alias("high"))


def top_values(df: DataFrame, attr: str, k: int) -> DataFrame:
    """The k most frequent values; ties go to the smaller value."""
    counts = df.groupBy(attr).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(attr)).limit(k)


def boolean_rate(df: DataFrame, flag: Column, *by: str) -> DataFrame:
    return df.groupBy(*by).agg(F.avg(flag.cast("double")).alias("rate"))


def l1_normalise(df: DataFrame, weight: str, by: list[str], name: str = "share") -> DataFrame:
    """Add each row's weight as a share of its group's total, or of the table's without a group."""
    w = F.col(weight).cast("double")
    if not by:
        return df.withColumn("_t", df.agg(F.sum(w)).scalar()).withColumn(name, safe_div(w, F.col("_t"))).drop("_t")
    totals = df.groupBy(*by).agg(F.sum(w).alias("_t"))
    return df.join(totals, by).withColumn(name, safe_div(w, F.col("_t"))).drop("_t")


def equi_matches(df: DataFrame, keys: list[str], name: str = "matches") -> DataFrame:
    """Add how many rows, itself included, equal each row in all keys."""
    return df.join(df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)), keys)


def value_difference(df: DataFrame, attr: str, other: DataFrame) -> DataFrame:
    """Values of a column that the other table's column of the same name does not have."""
    return domain(df, attr).join(other.select(attr), attr, "left_anti")


def never_together(df: DataFrame, pivot: str, attr: str) -> DataFrame:
    """Stretches of neighbouring domain values that no row has with a pivot value.

    ``pivot, first, last, n``: from ``first`` to ``last`` in the order of the domain lie ``n`` values that
    never occur with the pivot. There are at most as many stretches as distinct pairs plus pivots,
    so the result stays as small as what was seen, whatever the size of the domain. To draw from it
    use :mod:`cpdspark.operators.inject`, which finds the n-th missing value without listing any.
    """
    numbered = cut(global_rank(domain(df, attr), attr, "_rank"))
    seen = df.select(pivot, attr).dropna().distinct().join(numbered, attr).select(pivot, "_rank")
    gaps = with_previous(seen, [pivot], "_rank", "_prev").select(
        pivot, (F.coalesce(F.col("_prev"), F.lit(-1)) + 1).alias("_from"), (F.col("_rank") - 1).alias("_to")
    )
    size = numbered.agg(F.count(F.lit(1))).scalar()
    tail = (
        seen.groupBy(pivot)
        .agg((F.max("_rank") + 1).alias("_from"))
        .withColumn("_size", size)
        .select(pivot, "_from", (F.col("_size") - 1).alias("_to"))
    )
    missing = gaps.unionByName(tail).filter("_from <= _to").withColumn("n", F.col("_to") - F.col("_from") + 1)
    first = numbered.select(F.col("_rank").alias("_from"), F.col(attr).alias("first"))
    last = numbered.select(F.col("_rank").alias("_to"), F.col(attr).alias("last"))
    return missing.join(first, "_from").join(last, "_to").select(pivot, "first", "last", "n")
