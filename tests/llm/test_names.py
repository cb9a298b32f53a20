"""Further columns whose names the operators use themselves, hot buckets, rows that share an id."""

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cpdspark.llm import byte_bpe, decontaminate, line_quality, near_dedup, quality_pu, toxicity
from cpdspark.llm.names import fresh, others
from tests.llm import brute

NAMES = ["_kept", "_key", "_both", "_p", "_before", "_lines", "_rest", "_passes", "rep", "block", "key", "g", "_lost_chars", "P_", "piece", "row"]
TEXTS = ["one two three four five six seven eight nine ten eleven.", None, "", "word " * 50, "lang " * 9000 + "x", "one two three four five six seven eight nine ten eleven."]


@pytest.fixture(scope="module")
def wide(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id here at all, none")], "doc_id long, text string")
    for n in NAMES:
        df = df.withColumn(n, F.concat(F.lit(n), F.col("doc_id").cast("string")))
    return df.withColumn("tags", F.create_map(F.lit("a"), F.col("doc_id")))


def rows(df, *more):
    return sorted((tuple(str(r[c]) for c in ("doc_id", *NAMES, "tags", *more)) for r in df.collect()))


def test_fresh(spark):
    assert fresh(["_P", "_p_"], "_p") == "_p__" and len(others(["a", "B", "b c"], "b")) == 2


def test_columns_pass_through(spark, wide):
    same = rows(wide)
    v = byte_bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    assert rows(byte_bpe.encode(wide, v)) == same
    chain = [toxicity.Link("toxic", np.zeros(0, int), np.zeros(0), np.zeros(0), -1.0)]
    assert rows(toxicity.score(wide, chain)) == same
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    assert rows(decontaminate.find(wide, bench)) == same
    assert rows(quality_pu.score(wide, quality_pu.Model([], np.zeros(0), 0.5))) == same
    kept = rows(near_dedup.deduplicate(wide))
    assert kept == [r for r in same if r[0] != "5"]
    cleaned = line_quality.clean(wide)
    assert cleaned.columns == wide.columns and set(rows(cleaned)) <= set(same)


def test_results_replace_columns_of_their_name(spark, wide):
    v = byte_bpe.vocabulary(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    named = wide.withColumn("ids", F.lit("x")).withColumn("found", F.lit("x")).withColumn("score", F.lit("x")).withColumn("P_toxic", F.lit("x"))
    out = byte_bpe.encode(named, v)
    assert out.columns.count("ids") == 1 and out.schema["ids"].dataType.simpleString() == "binary"
    want = {str(i): brute.sha((t or "").encode()) for i, t in enumerate(TEXTS)}
    assert {str(r.doc_id): r.decoded_sha256 for r in out.collect() if r.doc_id is not None} == want
    bench = spark.createDataFrame([(1, "two three four five six seven eight nine ten eleven")], "item_id long, text string")
    found = decontaminate.find(named, bench)
    assert found.columns.count("found") == 1 and {r.doc_id for r in found.collect() if r.found["items"]} == {0, 5}

    chain = [toxicity.Link("toxic", np.zeros(0, int), np.zeros(0), np.zeros(0), -1.0)]
    assert [c.lower() for c in toxicity.score(named, chain).columns].count("p_toxic") == 1
    assert quality_pu.score(named, quality_pu.Model([], np.zeros(0), 0.5)).schema["score"].dataType.simpleString() == "double"


def test_rows_of_one_id_have_one_stand_in(spark):
    """Whatever the partitions, the row of the least text digest stays."""
    texts = [f"a text of its own, number {i}, about nothing else" for i in range(9)]
    df = spark.createDataFrame([(7, t, i) for i, t in enumerate(texts)] + [(8, "something quite different from all that", 0)], "doc_id long, text string, n int")
    want = min(texts, key=brute.sha)
    for parts in (1, 4):
        got = {r.doc_id: r.text for r in near_dedup.deduplicate(df.repartition(parts)).collect()}
        assert got[7] == want and len(got) == 2


def test_hot_bucket_in_blocks(spark, monkeypatch):
    """Many classes below the threshold around one template meet in buckets, and are compared block by block."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    template = [f"t{k}" for k in range(60)]
    docs = []
    for i in range(90):
        words = list(template)
        for k in range(2 + i % 3):
            words[(7 * i + 13 * k) % 60] = f"x{i}y{k}"
        docs.append((i, " ".join(words)))
    docs += [(200 + i, docs[i][1] + " tail") for i in range(10)]
    want = brute.near_components(docs, 4)
    got = near_dedup.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), width=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert len({c for _, c in want.values()}) > 5


def test_learning_rows_without_ids(spark):
    """Null ids and one hot id: every such row is drawn by its own text, and the fit ends with a model."""
    rows = [(i if i % 3 else None, f"good words number {i}, a sentence. Another one {i}!") for i in range(120)]
    rows += [(5, f"hot id text {i}") for i in range(60)]
    labels = [(i, i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = quality_pu.fit(df, spark.createDataFrame(labels, "doc_id long, quality int"))
    scores = quality_pu.score(df, model).collect()
    assert len(scores) == 180 and all(0 <= r.score <= 1 for r in scores)
