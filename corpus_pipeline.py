"""A training-data pipeline over ``documents``: each stage works on all that the one before has kept.

Stages: toxicity (documents that the classifier chain calls toxic go), near duplicates (one document of
each group stays), benchmark passages (documents with a window of a benchmark item go), secrets (masked
in the text), tokens (byte-level BPE ids). Between stages everything is written as Parquet into the
session's shared folder and read again, so a lost executor repeats one stage's tasks at most.

All stages but the last return the columns of ``documents``. Rows with null ids or texts pass the filters
unless their text is at fault; an empty table passes through empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from cpdspark.functions.lineage import shared_folder
from cpdspark.llm import byte_bpe, decontaminate, near_dedup, queries, secrets, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    scored = toxicity.score(docs.select(*COLUMNS), queries.toxicity_chain(spark, sf_dir, docs))
    return scored.filter(F.col("p_toxic") < toxicity.THRESHOLD).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicate(docs.select(*COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontaminate.find(docs.select(*COLUMNS), benchmark)
    return found.filter(F.size("found.items") == 0).select(*COLUMNS)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.mask(docs.select(*COLUMNS))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, lang, source, n_chars, n_tokens, ids_sha256, decoded_sha256``; the ids are in ``ids``."""
    encoded = byte_bpe.encode(docs.select(*COLUMNS), queries.bpe_vocabulary(spark))
    return encoded.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        "decoded_sha256",
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("secrets", mask_secrets),
    ("byte_bpe", tokenize),
]

#: A fitted model, verified near copies and entropy have no SQL form; the tests compare with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
