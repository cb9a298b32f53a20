"""Byte-level BPE by overlapping chunks.

A text is cut into chunks that overlap. Each chunk finds its pre-tokens by itself; where two
neighbours agree on a pre-token boundary in their overlap, the text is cut, and the pieces between cuts
are encoded independently. Pre-tokenising has no memory beyond the position, so two runs that share a
boundary stay together. Three rules make every cut safe: a chunk reports boundaries only behind its
first step from a character to white space, where every run has a boundary (the first chunk: from its
start); only boundaries with text on both sides, so that what ends there did not end for lack of text;
and none behind white space, because the rule for white space looks ahead. Neighbours that agree
nowhere (one endless word) are not cut but joined, whatever their length.

Chunks are spread over tasks by (text, chunk), so one huge text is many tasks' work. A text of a single
chunk has no neighbour and is encoded where it was read, without a shuffle; longer texts are told apart
by their SHA-256, so that copies are encoded once.

The vocabulary is a file of ranks whose path is a parameter of ``vocabulary``; the driver reads it (a
few MB at most by its fixed size) and sends it to the tasks.

Defined cases: a null text counts as empty and has no ids; null or repeated doc_ids and repeated rows
each give their row; an empty table gives no rows; further columns pass through ``encode``, but for
columns named like its results, which it replaces.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from cpdspark.llm.names import fresh, others

CHUNK, OVERLAP = 32_768, 1_024  # code points
OUTPUT_BYTES = 1 << 20


@dataclass(frozen=True)
class Vocabulary:
    pattern: str
    ranks: Broadcast  # the file's bytes


def vocabulary(spark: SparkSession, path: str, pattern: str) -> Vocabulary:
    with open(path, "rb") as f:
        return Vocabulary(pattern, spark.sparkContext.broadcast(f.read()))


@lru_cache(maxsize=2)
def _parsed(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}


@lru_cache(maxsize=2)
def _encoding(pattern: str, ranks: bytes) -> tiktoken.Encoding:
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=_parsed(ranks), special_tokens={})


@lru_cache(maxsize=2)
def _token_bytes(ranks: bytes) -> dict[int, bytes]:
    return {rank: token for token, rank in _parsed(ranks).items()}


def _slices(values: Iterator[bytes]) -> Iterator[pd.Series]:
    """Results in series of about ``OUTPUT_BYTES``, so that a task never holds those of a whole batch."""
    out, size = [], 0
    for v in values:
        out.append(v)
        size += len(v)
        if size >= OUTPUT_BYTES:
            yield pd.Series(out, dtype=object)
            out, size = [], 0
    if out:
        yield pd.Series(out, dtype=object)


def _encode_text(v: Vocabulary) -> Column:
    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bpe = _encoding(v.pattern, v.ranks.value)
        for texts in batches:
            yield from _slices(bpe.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() for t in texts)

    return encoded


def _bytes_of(ids: bytes, ranks: bytes) -> bytes:
    """The bytes of ids: those of each token, one after the other."""
    return b"".join(map(_token_bytes(ranks).__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _read_back(all_ids: Iterator[bytes], ranks: bytes) -> Iterator[pd.DataFrame]:
    """Ids with the digest of what they decode to, decoded by the task that made them."""
    for ids in _slices(all_ids):
        digests = [hashlib.sha256(_bytes_of(x, ranks)).hexdigest() for x in ids]
        yield pd.DataFrame({"ids": ids, "decoded_sha256": digests})


_READ_BACK = "struct<ids:binary,decoded_sha256:string>"


def _encode_and_decode(v: Vocabulary) -> Column:
    @F.pandas_udf(_READ_BACK)
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = _encoding(v.pattern, v.ranks.value)
        for texts in batches:
            yield from _read_back((bpe.encode_to_numpy(t, disallowed_special=()).astype("<u4").tobytes() for t in texts), v.ranks.value)

    return both


def decode(ids: str | Column, v: Vocabulary) -> Column:
    """The bytes of ids: those of each token, one after the other."""

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for all_ids in batches:
            yield from _slices(_bytes_of(x, v.ranks.value) for x in all_ids)

    return decoded(ids)


def safe_boundaries(text: str, pattern: str, first: bool, last: bool) -> list[int]:
    """Offsets at which a chunk may be cut: see the module's three rules."""
    step = regex.search(r"\S(?=\s)", text)
    known_from = 0 if first else step.end() if step else len(text)
    starts = (m.start() for m in regex.finditer(pattern, text))
    return [p for p in starts if p >= max(known_from, 1) and not text[p - 1].isspace()]


def _chunks(long_texts: DataFrame, chunk: int, overlap: int) -> DataFrame:
    n = F.length("text")
    rows = long_texts.select(
        "_key", "text", F.explode(F.sequence(F.lit(0), F.ceil(n / chunk).cast("int") - 1)).alias("i")
    )
    part = F.substring(F.col("text"), F.col("i") * chunk + 1, F.lit(chunk + overlap))
    return rows.select("_key", "i", part.alias("part")).dropDuplicates(["_key", "i"])


def _marks(chunks: DataFrame, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """Each chunk's boundaries in the overlaps with its neighbours, as offsets into the whole text."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            head, tail = [], []
            for i, part in zip(b.i, b.part):
                at = safe_boundaries(part, pattern, i == 0, False)
                head.append([i * chunk + p for p in at if p < overlap])
                tail.append([i * chunk + p for p in at if p >= chunk])
            yield pd.DataFrame({"_key": b["_key"], "i": b.i, "head": head, "tail": tail})

    return chunks.mapInPandas(find, "_key string, i int, head array<long>, tail array<long>")


def pieces(long_texts: DataFrame, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``_key, piece, text``: the texts cut where neighbouring chunks agree."""
    chunks = _chunks(long_texts, chunk, overlap)
    order = Window.partitionBy("_key").orderBy("i")
    cut = F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    cuts = _marks(chunks, pattern, chunk, overlap).withColumn("cut", cut)
    start = F.coalesce("cut", F.col("i").cast("long") * chunk)
    cuts = cuts.select(
        "_key",
        "i",
        F.sum(F.col("cut").isNotNull().cast("int")).over(order).alias("piece"),
        start.alias("start"),
        F.lead(start).over(order).alias("end"),
    )
    own = F.substring(
        F.col("part"),
        (F.col("start") - F.col("i") * chunk + 1).cast("int"),
        F.coalesce(F.col("end") - F.col("start"), F.lit(2**31 - 1)).cast("int"),
    )
    parts = chunks.join(cuts, ["_key", "i"]).select("_key", "piece", "i", own.alias("part"))
    ordered = F.array_sort(F.collect_list(F.struct("i", "part")))
    return parts.groupBy("_key", "piece").agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "").alias("text"))


def encode(documents: DataFrame, v: Vocabulary, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """All columns and ``ids``: little-endian unsigned 32-bit integers, as one binary value.

    Also ``decoded_sha256``, the hex digest of the bytes that these ids decode to. Both replace columns of
    these names. Encoding and decoding share a Python worker, so that an executor holds one vocabulary a core.
    """
    columns, own = others(documents.columns, "ids", "decoded_sha256"), fresh(documents.columns, "_both")
    text = F.coalesce("text", F.lit(""))
    results = [F.col(f"`{own}`")[c].alias(c) for c in ("ids", "decoded_sha256")]
    short = documents.filter(F.length(text) <= chunk).select(*columns, _encode_and_decode(v)(text).alias(own)).select(*columns, *results)
    long = documents.filter(F.length(text) > chunk)
    texts = long.select(F.sha2("text", 256).alias("_key"), "text")
    done = pieces(texts, v.pattern, chunk, overlap).select("_key", "piece", _encode_text(v)("text").alias("ids"))

    @F.pandas_udf(_READ_BACK)
    def joined(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for lists in batches:
            whole = (b"".join(x["ids"] for x in sorted(ids, key=lambda x: x["piece"])) for ids in lists)
            yield from _read_back(whole, v.ranks.value)

    key = fresh(documents.columns, "_key")
    whole = done.groupBy("_key").agg(F.collect_list(F.struct("piece", "ids")).alias("all"))
    whole = whole.select(F.col("_key").alias(key), joined("all").alias(own))
    return short.unionByName(long.withColumn(key, F.sha2("text", 256)).join(whole, key).select(*columns, *results))


def digest(documents: DataFrame, v: Vocabulary, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Counts and hashes of the ids, and of what they decode to."""
    ids = encode(documents.select("doc_id", "text"), v, chunk, overlap)
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return ids.select("doc_id", n_tokens, F.sha2("ids", 256).alias("ids_sha256"), "decoded_sha256")
