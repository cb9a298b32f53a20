"""What the registered queries share: tables, rounding, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from cpdspark.sources.embeddings import from_array_table
from cpdspark.operators.vocabulary import vocabulary

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to a fixed number of digits, so that engines agree on the last bits."""
    cols = [
        F.round(f.name, digits).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema
    ]
    return df.select(*cols)


def line_id(df: DataFrame) -> DataFrame:
    return df.withColumn("line_id", F.col("l_orderkey") * 10 + F.col("l_linenumber"))


# First vector number of each embedded attribute.
VECTOR_START = {"p_brand": 0, "p_type": 100, "p_name": 200}


def part_embeddings(spark: SparkSession, sf_dir: str, attrs: list[str]) -> DataFrame:
    """Give the i-th value of an attribute (sorted) the vector with number start + i."""
    codes = vocabulary(table(spark, sf_dir, "part"), attrs)
    start = F.lit(0)
    for a in attrs:
        start = F.when(F.col("attr") == a, F.lit(VECTOR_START[a])).otherwise(start)
    return from_array_table(
        table(spark, sf_dir, "embeddings"), "vec_id", "embedding", codes.withColumn("code", F.col("code") + start)
    )


def sql_embeddings(attrs: list[str]) -> str:
    """A CTE ``emb(attr, value, vec)`` with the same assignment."""
    parts = [
        f"""SELECT '{a}' AS attr, v AS value, CAST(e.embedding AS DOUBLE[]) AS vec
        FROM (SELECT v, row_number() OVER (ORDER BY v) - 1 + {VECTOR_START[a]} AS code
              FROM (SELECT DISTINCT {a} AS v FROM part)) x JOIN embeddings e ON e.vec_id = x.code"""
        for a in attrs
    ]
    return "emb AS (" + " UNION ALL ".join(parts) + ")"


def sql_distances(attrs: list[str]) -> str:
    """CTEs ``dist_<attr>(a, b, d)`` between all values of an attribute."""
    return ", ".join(
        f"""dist_{a} AS (SELECT x.value AS a, y.value AS b, round(abs(list_cosine_distance(x.vec, y.vec)), 12) AS d
        FROM emb x JOIN emb y ON x.attr = y.attr WHERE x.attr = '{a}')"""
        for a in attrs
    )


def sql_unit(seed: int, *parts: str) -> str:
    """The library's uniform draw in SQL; parts are SQL expressions or quoted tags."""
    text = f"concat_ws('|', '{seed}', {', '.join(parts)})"
    return f"(CAST('0x' || substr(md5({text}), 1, 12) AS BIGINT) / 281474976710656.0)"


def sql_index(u: str, size: str) -> str:
    return f"CAST(least(floor({u} * {size}), {size} - 1) AS BIGINT)"


def sql_normal(x: str, m: str, s: str) -> str:
    return f"(-(({x}) - ({m})) * (({x}) - ({m})) / (2.0 * ({s}) * ({s})) - 0.5 * ln(2.0 * pi() * ({s}) * ({s})))"


def sql_smoothed(c: str, n: str, seen: str, d: str) -> str:
    """Log probability with a tenth of the seen mass for unseen values."""
    return (
        f"ln(CASE WHEN {n} = 0 THEN 1.0::DOUBLE / {d} "
        f"WHEN {c} > 0 THEN {c}::DOUBLE / ({n} * (CASE WHEN {d} > {seen} THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END)) "
        f"ELSE 0.1::DOUBLE / (1.1::DOUBLE * ({d} - {seen})) END)"
    )


def double(c: str) -> Column:
    return F.col(c).cast("double")
