import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cpdspark.functions.lineage import cut
from cpdspark.operators import score as scoring
from cpdspark.operators.score import explain, most_improbable, score, score_row
from cpdspark.plans.spec import (
    ModelSpec,
    band,
    bernoulli,
    cat,
    emb_cat,
    emb_num,
    freq,
    hard,
    num,
    uniform,
    uniform_cont,
)
from tests import brute


def make(n=160, seed=3):
    r = np.random.RandomState(seed)
    state = r.choice(["A", "B", "C"], n, p=[0.6, 0.3, 0.1])
    city = np.array([s + str(r.randint(0, 3)) for s in state])
    space = np.round(r.uniform(20, 120, n), 2)
    year = r.choice([1950, 1970, 1990], n)
    flag = r.rand(n) < 0.3
    rent = np.round(space * (5 + (state == "B")) + r.normal(0, 20, n), 2)
    return pd.DataFrame(
        dict(id=np.arange(n), state=state, city=city, space=space, year=year, flag=flag.astype(int), rent=rent)
    )


def vectors(spark, df, attrs, seed=5):
    r = np.random.RandomState(seed)
    rows = [(a, str(v), r.normal(size=8).tolist()) for a in attrs for v in sorted(df[a].unique())]
    emb = {(a, v): np.array(x) for a, v, x in rows}
    return emb, spark.createDataFrame(rows, "attr string, value string, vec array<double>")


PLAIN = ModelSpec(
    (
        uniform("state"),
        cat("city", "state"),
        num("space", "state", "city"),
        cat("year", "city", band("space", 10)),
        bernoulli("flag"),
        num("rent", band("space", 10), "state", "city", "year"),
    )
)
EMB = ModelSpec(
    (
        freq("state"),
        emb_cat("city", "state", k=1),
        uniform_cont("space"),
        emb_cat("year", "city", band("space", 30), k=15),
        bernoulli("flag"),
        emb_num("rent", band("space", 10), "state", "city", "year", hard("flag"), k=15),
    )
)


def check(got, want, id_col="id"):
    got = got.toPandas().sort_values(id_col).reset_index(drop=True)
    want = want.sort_values(id_col).reset_index(drop=True)
    assert len(got) == len(want)
    for c in want.columns:
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9, err_msg=c)


def test_plain_equals_row_masks(spark):
    df = make()
    check(score(spark.createDataFrame(df), PLAIN, "id"), brute.score(df, PLAIN, "id"))


def test_embedded_equals_row_masks(spark):
    df = make()
    emb, emb_df = vectors(spark, df, ["state", "city", "year"])
    check(score(spark.createDataFrame(df), EMB, "id", emb_df), brute.score(df, EMB, "id", emb))


def test_new_rows_and_relaxed(spark):
    obs, new = make(), make(60, 9)
    obs = obs[obs.city != "C1"]
    emb, emb_df = vectors(spark, pd.concat([obs, new]), ["state", "city", "year"])
    spec = ModelSpec(
        (
            uniform("state"),
            uniform("city"),
            cat("year", "state", "city", strict=False),
            uniform_cont("space"),
            bernoulli("flag"),
            num("rent", "state", "city", band("space", 3), "year", strict=False, greater_zero=True),
        )
    )
    o, n = spark.createDataFrame(obs), spark.createDataFrame(new)
    check(score(o, spec, "id", rows=n), brute.score(obs, spec, "id", rows=new))
    check(score(o, EMB, "id", emb_df, rows=n), brute.score(obs, EMB, "id", emb, rows=new))


def test_nulls_are_skipped_and_labels_kept(spark):
    df = make()
    sdf = spark.createDataFrame(df).withColumn("city", F.when(F.col("id") != 5, F.col("city")))
    got = score(sdf, PLAIN, "id").toPandas().set_index("id")
    assert bool(got.loc[5, "skipped"]) and np.isnan(got.loc[5, "score"])
    want = brute.score(df[df.id != 5], PLAIN, "id").set_index("id")
    np.testing.assert_allclose(got.loc[want.index, "score"], want["score"], rtol=1e-9)


@pytest.mark.parametrize("parts", [1, 7])
def test_partitioning_does_not_matter(spark, parts):
    df = make()
    got = score(spark.createDataFrame(df).repartition(parts), PLAIN, "id")
    check(got, brute.score(df, PLAIN, "id"))


def test_lookups_above_the_broadcast_limit(spark, monkeypatch):
    """Tables that are joined to finer ones first give the same scores, with rows that lack a value."""
    df = make(80)
    spec = ModelSpec((
        uniform("state"), cat("city", "state"), num("space", "city", "state"), cat("year", "city", band("space", 10)),
        num("rent", band("space", 10), "state", "city", "year"),
    ))
    sdf = spark.createDataFrame(df).withColumn("state", F.when(F.col("id") != 5, F.col("state")))
    monkeypatch.setattr(scoring, "BROADCAST_ROWS", 0)
    got = score(sdf, spec, "id").toPandas().set_index("id")
    want = brute.score(df[df.id != 5], spec, "id").set_index("id")
    assert len(got) == len(df) and got.loc[5, "skipped"] and np.isnan(got.loc[5, "score"])
    for c in want.columns:
        np.testing.assert_allclose(got.loc[want.index, c].astype(float), want[c].astype(float), rtol=1e-9, atol=1e-9)


def test_rows_are_shuffled_once_for_nested_lookups(spark, monkeypatch, tmp_path):
    """However many tables are too large for a broadcast, and none of them is checkpointed."""
    spark.createDataFrame(make()).write.parquet(str(tmp_path / "t"))
    spec = ModelSpec((uniform("state"), cat("city", "state"), num("space", "city", "state"), num("rent", "state", "city", band("space", 10))))
    monkeypatch.setattr(scoring, "sized", cut)
    monkeypatch.setattr(scoring, "BROADCAST_ROWS", 0, raising=False)
    for key in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
        spark.conf.set(key, {"spark.sql.adaptive.enabled": "false"}.get(key, "-1"))
    try:
        scored = score(spark.read.parquet(str(tmp_path / "t")), spec, "id")
        todo, exchanges = [scored._jdf.queryExecution().executedPlan()], 0
        while todo:
            plan = todo.pop()
            out = plan.output().mkString(" ")
            exchanges += plan.nodeName() == "Exchange" and any(c.split("#")[0] == "id" for c in out.split(" "))
            todo += [plan.children().apply(i) for i in range(plan.children().size())]
        assert exchanges == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_top_and_explain(spark):
    df = make()
    df.loc[7, "rent"] = 9000.0
    scored = score(spark.createDataFrame(df), PLAIN, "id")
    worst = explain(most_improbable(scored, 1, "id"), PLAIN).first()
    assert worst["id"] == 7 and worst["worst_attr"] == "rent"
    one = score_row(spark.createDataFrame(df), PLAIN, "id", df.iloc[7].to_dict()).first()
    assert abs(one["score"] - worst["score"]) < 1e-9
