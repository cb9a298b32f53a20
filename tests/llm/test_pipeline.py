"""The stages one after the other, each against a plain counterpart on its own input."""

import corpus_pipeline
from cpdspark.llm import queries, toxicity
from cpdspark.llm.text_arrays import as_bytes
from tests.llm import brute

PASSAGE = "one two three four five six seven eight nine ten eleven twelve"


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(2).write.parquet(path)


def test_stages(spark, tmp_path):
    word = lambda i, k: f"w{(i * 7919 + k * 104729) % 5003}"
    rows = [(i, " ".join(word(i, k) for k in range(30 + i % 9)) + (" grobnik" if i % 6 == 0 else ""), "en", "s", 1) for i in range(120)]
    rows += [(200, rows[1][1], "en", "s", 1), (201, rows[2][1] + " tail", "en", "s", 1), (202, "see " + PASSAGE + " ok", "en", "s", 1)]
    rows += [(203, "the password: hunter2222 is here", "en", "s", 1), (None, None, None, None, None), (204, None, "en", None, 0), (1, *rows[1][1:])]
    labels = [(i, 1, int(i % 6 == 0)) for i in range(120)]
    sf = str(tmp_path)
    write(spark, f"{sf}/documents.parquet", rows, "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, f"{sf}/labels.parquet", labels, "doc_id long, quality int, toxic int")
    write(spark, f"{sf}/benchmark.parquet", [(1, PASSAGE), (None, "x"), (2, None)], "item_id long, text string")

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, names = [], [n for n, _ in corpus_pipeline.STAGES]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != names[-1]:
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{sf}/out/{name}")
        docs = spark.read.parquet(f"{sf}/out/{name}")
        kept.append([(r.doc_id, getattr(r, "text", None)) for r in docs.collect()])
    ids = [sorted(-1 if i is None else i for i, _ in k) for k in kept]
    everything = sorted(-1 if r[0] is None else r[0] for r in rows)

    assert ids[0] == [i for i in everything if not (i < 120 and i % 6 == 0 and i >= 0)]
    component = brute.near_components([(i, t) for i, t in kept[0] if i is not None], 5)
    assert ids[1] == sorted([-1, *(i for i, (_, c) in component.items() if i == c)]) and 200 not in ids[1] and 201 not in ids[1]
    windows = brute.benchmark_windows([(1, PASSAGE)])
    assert ids[2] == sorted(-1 if i is None else i for i, t in kept[1] if not brute.benchmark_hits(t, windows)[1]) and 202 not in ids[2]
    before, after = dict(kept[2]), dict(kept[3])
    assert after[203] == "the [masked] is here" and all(after[i] == before[i] for i in before if i != 203) and ids[3] == ids[2]
    assert ids[4] == ids[3]
    decoded = {r.doc_id: r.decoded_sha256 for r in docs.collect()}
    assert decoded == {i: brute.sha(as_bytes(t)) for i, t in after.items()}


def test_run_and_registration(spark, tmp_path):
    import __spark_entry__ as entry

    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n in entry.queries() if n.startswith("op")] == [n for n in queries.QUERIES]
    assert corpus_pipeline.ORACLE_SQL is None and toxicity.THRESHOLD == 0.5
    sf = str(tmp_path)
    write(spark, f"{sf}/documents.parquet", [], "doc_id long, text string, lang string, source string, n_chars long")
    write(spark, f"{sf}/labels.parquet", [], "doc_id long, quality int, toxic int")
    write(spark, f"{sf}/benchmark.parquet", [], "item_id long, text string")
    assert corpus_pipeline.run(spark, sf).collect() == []
