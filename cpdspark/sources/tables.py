"""Tables in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; the schema is given, so the file is read once."""
    return spark.read.schema(schema).option("header", True).csv(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def register(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Run SQL over named tables."""
    for name, df in tables.items():
        register(df, name)
    return spark.sql(sql)


def write_scenarios(df: DataFrame, path: str, mode: str = "error") -> None:
    """One folder per scenario."""
    df.write.mode(mode).partitionBy("scenario").option("header", True).csv(path)
