"""Row predicates by role, relaxed conjunctions, and cells of a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from cpdspark.operators.bands import grid, grid_radius


def value_mask(attr: str, values: list) -> Column:
    return F.col(attr).isin(values)


def band_mask(attr: str, value: float, radius: float) -> Column:
    """Inclusive at both ends, exact on the decimal grid."""
    return F.abs(grid(F.col(attr)) - grid(F.lit(value))) <= grid_radius(radius)


def conjunction(masks: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, masks, F.lit(True))


def relaxed_filter(df: DataFrame, masks: list[Column]) -> DataFrame:
    """Apply predicates from left to right; one that would leave no row is skipped.

    Which predicates stay depends on 2^m existence tests at most. They are all answered by one
    aggregate over the pattern of fulfilled predicates, which has at most 2^m rows.
    """
    bits = sum((F.when(m, F.lit(1 << i)).otherwise(0) for i, m in enumerate(masks)), F.lit(0))
    patterns = df.select(bits.alias("_p")).distinct().agg(F.collect_list("_p")).scalar()
    work = df.withColumn("_patterns", patterns).withColumn("_keep", F.lit(0))
    for i in range(len(masks)):
        trial = F.col("_keep").bitwiseOR(F.lit(1 << i))
        work = work.withColumn("_trial", trial)
        ok = F.exists("_patterns", lambda p: p.bitwiseAND(F.col("_trial")) == F.col("_trial"))
        work = work.withColumn("_keep", F.when(ok, F.col("_trial")).otherwise(F.col("_keep")))
    return work.filter(bits.bitwiseAND(F.col("_keep")) == F.col("_keep")).select(*df.columns)


def without_labels(df: DataFrame, label: str = "negative_sample") -> DataFrame:
    return df.filter(F.col(label) == 0)


def cells(df: DataFrame, id_col: str, ignore: list[str] = ()) -> DataFrame:
    """Wide rows to (id, attr, value) cells, without the ignored attributes."""
    attrs = [c for c in df.columns if c != id_col and c not in ignore]
    text = df.select(id_col, *[F.col(a).cast("string").alias(a) for a in attrs])
    return text.unpivot(id_col, attrs, "attr", "value")


def read_back(cells_df: DataFrame, id_col: str, attrs: list[str]) -> DataFrame:
    """Cells back to wide rows with the listed attributes."""
    return cells_df.groupBy(id_col).pivot("attr", attrs).agg(F.first("value"))


def pop_target(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """A table without its target column, and the target column."""
    return df.drop(target), df.select(target)
