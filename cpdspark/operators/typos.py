"""Typos in a text column, reproducible by seed and id."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cpdspark.functions.rng import tagged
from cpdspark.functions.text import add_typos, halving_typo_count, typo_count


def inject_typos(
    df: DataFrame, id_col: str, attr: str, seed: int, prob: float | None = None, out: str = "dirty"
) -> DataFrame:
    """Add the text with typos and their number ``n_typos``.

    The number of typos falls off geometrically; with ``prob`` typos are added one by one, each
    with half the chance of the one before.
    """
    key = F.col(id_col)
    count = typo_count(tagged(seed, "typos", key)) if prob is None else halving_typo_count(seed, prob, key)
    counted = df.withColumn("n_typos", count.cast("int"))
    return counted.withColumn(out, add_typos(F.col(attr), F.col("n_typos"), seed, key))
