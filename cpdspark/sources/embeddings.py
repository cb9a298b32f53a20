"""Value embeddings as pairs of text files: one value per line, one vector per line, same order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from cpdspark.functions.lineage import cut
from cpdspark.operators.cumulative import chunks_for, global_rank


def _numbered_lines(spark: SparkSession, path: str, value: str) -> DataFrame:
    """Lines with their number, over all splits of a file and all parts of a folder."""
    place = F.struct(
        F.col("_metadata.file_path").alias("f"),
        F.col("_metadata.file_block_start").alias("b"),
        F.monotonically_increasing_id().alias("i"),
    )
    lines = cut(spark.read.text(path).select(F.col("value").alias(value), place.alias("_place")))
    return global_rank(lines, "_place", "_line", chunks_for(lines)).select("_line", value)


def read_pair(spark: SparkSession, attr: str, meta_path: str, vec_path: str) -> DataFrame:
    """``attr, value, vec`` of one attribute."""
    values = _numbered_lines(spark, meta_path, "value")
    vectors = _numbered_lines(spark, vec_path, "line")
    vec = F.transform(F.split("line", "\t"), lambda x: x.cast("double"))
    return values.join(vectors, "_line").select(F.lit(attr).alias("attr"), "value", vec.alias("vec"))


def read_pairs(spark: SparkSession, attrs: list[str], prefix: str) -> DataFrame:
    """All attributes of a training run: ``<prefix><attr>_meta.tsv`` and ``<prefix><attr>_vec.tsv``."""
    parts = [read_pair(spark, a, f"{prefix}{a}_meta.tsv", f"{prefix}{a}_vec.tsv") for a in attrs]
    return reduce(DataFrame.unionByName, parts)


def write_pairs(emb: DataFrame, attrs: list[str], prefix: str, mode: str = "error") -> None:
    """Two folders of text per attribute, lines sorted by value."""
    for a in attrs:
        mine = emb.filter(F.col("attr") == a).orderBy("value")
        mine.select("value").write.mode(mode).text(f"{prefix}{a}_meta.tsv")
        line = F.concat_ws("\t", F.transform("vec", lambda x: x.cast("string")))
        mine.select(line).write.mode(mode).text(f"{prefix}{a}_vec.tsv")


def from_array_table(df: DataFrame, index: str, vec: str, values: DataFrame) -> DataFrame:
    """Pair numbered values (``attr, value, code``) with vectors of the same number."""
    vectors = df.select(F.col(index).alias("code"), F.col(vec).cast("array<double>").alias("vec"))
    return values.join(vectors, "code").select("attr", "value", "vec")
