"""Random draws of attribute values, without a list of candidates per key.

Values of an attribute are numbered once. What occurs with a key is kept as numbers too, so the
n-th value that never occurs with the key, the n-th that does, and the value of the key's n-th
row are all found by counting. Keys with very many values are split over tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from cpdspark.functions.lineage import cut
from cpdspark.functions.rng import pick_index
from cpdspark.operators.cumulative import chunks_for, rank_in, running_totals, totals_at

NEVER, SEEN, ROW = "never", "seen", "row"
WITHIN = "|"  # between the name of a table and that of an attribute


@dataclass
class Seen:
    """Numbered values per attribute, and what occurs with every key."""

    numbered: DataFrame  # attr, value, rank
    pairs: DataFrame  # attr, key, value, rank, i (number among the key's values), upto (rows up to and with it)
    sizes: DataFrame  # attr, key, n_seen, n_rows, n_never
    chunks: int


def seen_values(pairs: DataFrame) -> Seen:
    """``pairs`` is ``attr, key, value, n``: distinct co-occurring values with their rows."""
    counted = cut(pairs)
    chunks = chunks_for(counted)
    numbered = cut(rank_in(counted.select("attr", "value").distinct(), ["attr"], "value", "rank", chunks))
    ranked = counted.join(numbered, ["attr", "value"]).withColumn("i", F.lit(1).cast("long"))
    ranked = ranked.withColumn("upto", F.col("n"))
    placed = running_totals(ranked, ["attr", "key"], "rank", {"i": "sum", "upto": "sum"}, chunks)
    placed = cut(placed.withColumn("i", F.col("i") - 1))
    domains = numbered.groupBy("attr").agg(F.count(F.lit(1)).alias("_d"))
    sizes = (
        placed.groupBy("attr", "key")
        .agg(F.count(F.lit(1)).alias("n_seen"), F.sum("n").alias("n_rows"))
        .join(domains, "attr")
        .withColumn("n_never", F.col("_d") - F.col("n_seen"))
        .drop("_d")
    )
    return Seen(numbered, placed, sizes, chunks)


def pairs_of(df: DataFrame, key: str, attrs: list[str], within: str | None = None) -> DataFrame:
    """Co-occurring values of several attributes with one key column, in long form.

    ``within`` names a column whose values are tables of their own: attributes are then called
    ``<value>|<attribute>``, so that each of these tables has its own values and counts.
    """
    name = lambda a: F.lit(a) if within is None else F.concat_ws(WITHIN, within, F.lit(a))
    text = df.select(
        F.col(key).cast("string").alias("key"),
        F.explode(
            F.array(*[F.struct(name(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attrs])
        ).alias("_c"),
    )
    long = text.select("key", F.col("_c.attr").alias("attr"), F.col("_c.value").alias("value"))
    return long.dropna().groupBy("attr", "key", "value").agg(F.count(F.lit(1)).alias("n"))


def draw(cells: DataFrame, seen: Seen, fallback: str | None = None) -> DataFrame:
    """``cells`` (any id columns, ``attr, key, mode, u``) with the drawn ``value``.

    Mode ``never`` draws among values that do not occur with the key, ``seen`` among its distinct
    values, ``row`` among its rows. ``fallback`` replaces ``never`` where every value occurs; without
    it the value is null there.
    """
    ids = [c for c in cells.columns if c not in ("attr", "key", "mode", "u")]
    sized = cells.join(seen.sizes, ["attr", "key"])
    if fallback:
        empty = (F.col("mode") == NEVER) & (F.col("n_never") == 0)
        sized = sized.withColumn("mode", F.when(empty, F.lit(fallback)).otherwise(F.col("mode")))
    size = F.when(F.col("mode") == NEVER, F.col("n_never")).when(F.col("mode") == SEEN, F.col("n_seen"))
    indexed = sized.withColumn("at", pick_index(F.col("u"), size.otherwise(F.col("n_rows")))).drop(
        "u", "n_seen", "n_rows", "n_never"
    )
    indexed = cut(indexed)
    keys = ["attr", "key"]

    # Seen numbers r_0 < r_1 < ...: below the n-th missing number lie those with r_i - i <= n.
    gaps = seen.pairs.groupBy(*keys, (F.col("rank") - F.col("i")).alias("at")).agg(F.count(F.lit(1)).alias("below"))
    never = totals_at(gaps, indexed.filter(F.col("mode") == NEVER), keys, "at", {"below": "sum"}, seen.chunks)
    never = (
        never.withColumn("rank", F.col("at") + F.col("below"))
        .join(seen.numbered, ["attr", "rank"], "left")
        .select(*ids, "attr", "value")
    )
    among = indexed.filter(F.col("mode") == SEEN).withColumn("i", F.col("at"))
    ends = seen.pairs.groupBy(*keys, F.col("upto").alias("at")).agg(F.count(F.lit(1)).alias("i"))
    by_row = totals_at(ends, indexed.filter(F.col("mode") == ROW), keys, "at", {"i": "sum"}, seen.chunks)
    listed = among.select(*ids, *keys, "i").unionByName(by_row.select(*ids, *keys, "i"))
    listed = listed.join(seen.pairs.select(*keys, "i", "value"), [*keys, "i"], "left")
    return never.unionByName(listed.select(*ids, "attr", "value"))


def widen(drawn: DataFrame, ids: list[str], schema, attrs: list[str], prefix: str = "_new_") -> DataFrame:
    """Drawn cells to one row per id, cast to the types of the table they came from."""
    wide = drawn.groupBy(*ids).pivot("attr", attrs).agg(F.first("value"))
    return wide.select(*ids, *[F.col(f"`{a}`").cast(schema[a].dataType).alias(prefix + a) for a in attrs])
