"""The registered queries of the operators in this folder, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from cpdspark.llm.oracles import ORACLES  # noqa: F401
from cpdspark.llm import (
    byte_bpe,
    chat,
    decontaminate,
    filter_audit,
    html_text,
    line_quality,
    near_dedup,
    pii,
    quality_pu,
    secrets,
    source_divergence,
    substring_dedup,
    toxicity,
)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    table = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(
            F.array(*[
                F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text"))
                for i, r in enumerate(("user", "assistant"))
            ])
        ).alias("t"),
    )
    return chat.digest(chat.layout(table.unionByName(own.select("conv_id", "t.*"))))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(_read(spark, sf_dir, "documents"))


def toxicity_chain(spark: SparkSession, sf_dir: str, documents: DataFrame) -> list[toxicity.Link]:
    """Low quality first, then toxic: the chain of the labels at hand."""
    labels = _read(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.fit(documents, labels, ["low_quality", "toxic"])


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(documents, toxicity_chain(spark, sf_dir, documents))
    return scored.select(
        "doc_id",
        (~toxicity.learnable()).alias("held_out"),
        "p_low_quality",
        "p_toxic",
        (F.col("p_toxic") >= toxicity.THRESHOLD).alias("toxic"),
    )


def bpe_vocabulary(spark: SparkSession) -> byte_bpe.Vocabulary:
    return byte_bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(_read(spark, sf_dir, "documents"), bpe_vocabulary(spark))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find(_read(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.report(_read(spark, sf_dir, "documents"), width=4)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.measure(_read(spark, sf_dir, "documents"))


def op9_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _read(spark, sf_dir, "documents")
    model = quality_pu.fit(documents, _read(spark, sf_dir, "labels"))
    return quality_pu.score(documents.select("doc_id", "text"), model).select(
        "doc_id",
        (~toxicity.learnable()).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rendered = html_text.extract(_read(spark, sf_dir, "pages").select("page_id", "html"))
    return rendered.select("page_id", F.length("text").cast("long").alias("n_chars"), "text")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_read(spark, sf_dir, "documents"))


def op13_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_prefix_targets": op1_prefix_targets,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_toxicity": op3_toxicity,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_secrets": op5_secrets,
    "op6_near_dedup": op6_near_dedup,
    "op7_decontaminate": op7_decontaminate,
    "op8_line_quality": op8_line_quality,
    "op9_quality_pu": op9_quality_pu,
    "op10_html_text": op10_html_text,
    "op11_filter_audit": op11_filter_audit,
    "op12_source_divergence": op12_source_divergence,
    "op13_pii": op13_pii,
}
