"""The paths for large keys give the same results as the plain ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cpdspark.functions.lineage import cut
from cpdspark.operators import bands, cpd, cumulative, knn
from cpdspark.operators.counts import domain, never_together
from cpdspark.operators.metrics import pr_roc, roc_auc
from cpdspark.plans.spec import band, cat, num


def skewed(n=400, seed=1):
    """Two thirds of all rows have one key."""
    r = np.random.RandomState(seed)
    key = np.where(r.rand(n) < 0.67, "hot", r.choice(["a", "b", "c"], n))
    x = np.round(r.uniform(0, 50, n), 1)
    return pd.DataFrame(dict(id=np.arange(n), key=key, x=x, v=r.choice(list("pqrst"), n), y=np.round(r.normal(5, 2, n), 3)))


@pytest.mark.parametrize("chunks", [1, 5, 300])
def test_running_totals(spark, chunks):
    df = skewed()
    got = cumulative.running_totals(spark.createDataFrame(df).withColumn("n", F.lit(1)), ["key"], "x", {"n": "sum", "y": "min"}, chunks)
    got = got.toPandas().sort_values("id").reset_index(drop=True)
    for _, row in df.iterrows():
        before = df[(df.key == row.key) & (df.x <= row.x)]
        assert got.loc[row.id, "n"] == len(before)
        assert got.loc[row.id, "y"] == before.y.min()


def test_global_rank_of_text(spark):
    words = [f"word-{i:05d}" for i in np.random.RandomState(0).permutation(700)]
    got = cumulative.global_rank(spark.createDataFrame([(w,) for w in words], "w string"), "w", "r", 9).toPandas()
    assert got.sort_values("w")["r"].tolist() == list(range(700))


@pytest.mark.parametrize("source", ["parquet", "checkpoint", "tuples"])
def test_ranks_whose_order_is_not_read(spark, tmp_path, source):
    """The order column is pruned above the ranks; no filter on the chunk may need it there."""
    df = spark.createDataFrame([("k", f"w{i:03d}") for i in range(300)] * 2, "key string, name string")
    if source == "parquet":
        df.write.parquet(str(tmp_path / "t"))
        df = spark.read.parquet(str(tmp_path / "t"))
    if source == "checkpoint":
        df = cut(df)
    total = sum(range(300))
    ranked = cumulative.global_rank(domain(df, "name"), "name", "r", 4)
    assert ranked.agg(F.sum("r")).first()[0] == total
    assert cumulative.rank_in(df.distinct(), ["key"], "name", "r", 4).agg(F.sum("r")).first()[0] == total
    assert sorted(r[1] for r in cumulative.global_rank(domain(df, "name"), "name", "r", 300).collect()) == list(range(300))


@pytest.mark.parametrize("per_chunk", [60, 250_000])
def test_bands_against_plain_sums(spark, monkeypatch, per_chunk):
    df = skewed()
    sdf = spark.createDataFrame(df)
    node_c, node_n = cat("v", "key", band("x", 2.5)), num("y", "key", band("x", 2.5))
    monkeypatch.setattr(cumulative, "POINTS_PER_CHUNK", per_chunk)
    got_c = cpd.categorical(sdf, node_c).toPandas()
    got_n = cpd.numerical(sdf, node_n).toPandas()
    size = df.v.nunique()
    near_of = lambda row: df[(df.key == row.key) & ((df.x - row[cpd.POS] / 1e6).abs().round(6) <= 2.5)]
    assert len(got_c) == len(df[["key", "x", "v"]].drop_duplicates())
    for _, row in got_c.head(40).iterrows():
        near = near_of(row)
        p = (near.v == row.v).sum() / len(near) / (1.1 if near.v.nunique() < size else 1)
        assert abs(row.lp - np.log(p)) < 1e-9
    for _, row in got_n.head(40).iterrows():
        near = near_of(row)
        if len(near) > 1:
            assert abs(near.y.mean() - row["mean"]) < 1e-9 and abs(near.y.std() - row["std"]) < 1e-9


def test_band_moments_by_key_and_by_chunk(spark):
    """Both ways agree, also on null keys and positions, and where others than the points are asked for."""
    r = np.random.RandomState(7)
    rows = [(str(k) if k else None, int(x) if x > -40 else None, float(y)) for k, x, y in zip(r.randint(0, 4, 300), r.randint(-45, 40, 300), r.normal(0, 3, 300))]
    points = cut(bands.moment_points(spark.createDataFrame(rows, "k string, pos long, y double"), ["k"], "pos", "y", F.lit(0.5)))
    mine = points.select("k", "pos")
    other = spark.createDataFrame([(str(k), x) for k in range(1, 6) for x in range(-60, 60)], "k string, pos long")
    rounded = lambda df: sorted(map(str, df.select("k", "pos", "n", *[F.round(c, 9) + 0.0 for c in ("s1", "s2", "lo", "hi")]).collect()))
    for radius in (1, 7, 100):
        for asked in (mine, other):
            want = rounded(bands._moments_by_chunk(points, asked, ["k"], "pos", radius, 1))
            assert rounded(bands._moments_by_key(points, asked, ["k"], "pos", radius)) == want
        assert rounded(bands._moments_by_key(points, None, ["k"], "pos", radius)) == rounded(bands._moments_by_chunk(points, mine, ["k"], "pos", radius, 1))


def test_bands_of_few_positions_are_shuffled_once(spark):
    """Beyond the points themselves the plan has a single exchange."""
    df = spark.range(500).select((F.col("id") % 7).alias("k"), (F.col("id") % 11).alias("pos"), F.col("id").cast("double").alias("y"))
    points = cut(bands.moment_points(df, ["k"], "pos", "y", F.lit(0.0)))
    plan = bands.band_moments(points, None, ["k"], "pos", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_points_that_are_read_once_are_not_checkpointed(spark, monkeypatch):
    """A band that asks about its own points has no checkpoint of them, unless positions are cut into chunks."""
    done = []
    for module in (cpd, bands):
        monkeypatch.setattr(module, "cut", lambda df: done.append(1) or cut(df), raising=False)
    df, node = spark.createDataFrame(skewed()), num("y", "key", band("x", 2.5))
    rows = lambda: sorted((r["key"], r[cpd.POS], r.n, round(r["mean"], 9), round(r.std, 9)) for r in cpd.numerical(df, node).collect())
    want = rows()
    assert done == []
    monkeypatch.setattr(cumulative, "POINTS_PER_CHUNK", 60)
    assert rows() == want and done


def test_nearest_does_not_depend_on_chunks(spark, monkeypatch):
    r = np.random.RandomState(2)
    vals = [("a", f"v{i}", r.normal(size=6).tolist()) for i in range(40)]
    values = spark.createDataFrame(vals, "attr string, value string, vec array<double>")
    want = knn.value_neighbours(values, 4).toPandas().sort_values(["value", "rank"]).reset_index(drop=True)
    monkeypatch.setattr(knn, "QUERY_CHUNK", 7)
    monkeypatch.setattr(knn, "CANDIDATE_CHUNK", 5)
    monkeypatch.setattr(knn, "_SLICE_CELLS", 10)
    got = knn.value_neighbours(values, 4).toPandas().sort_values(["value", "rank"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(got, want)
    m = {v: np.array(x) for _, v, x in vals}
    one = sorted((round(abs(1 - m["v0"] @ m[o] / np.linalg.norm(m["v0"]) / np.linalg.norm(m[o])), 12), o) for o in m if o != "v0")
    assert [o for _, o in one[:4]] == want[want.value == "v0"]["neighbour"].tolist()


def test_missing_vector(spark):
    values = spark.createDataFrame([("a", "x", [1.0])], "attr string, value string, vec array<double>")
    df = spark.createDataFrame([("x",), ("z",)], "a string")
    assert knn.with_vectors(df, values, ["a"], missing="null").filter(F.col("_vec_a").isNull()).count() == 1
    with pytest.raises(Exception, match="no vector for a=z"):
        knn.with_vectors(df, values, ["a"]).collect()


def _count_pairs(monkeypatch):
    """Pairs that the comparing tasks get, added up over all comparisons."""
    total, plain = [0], knn._chunked

    def counting(q, c, keys):
        if keys:
            sizes = q.groupBy(*keys).agg(F.count("*").alias("n")).join(c.groupBy(*keys).agg(F.count("*").alias("m")), keys)
            total[0] += sizes.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0
        return plain(q, c, keys)

    monkeypatch.setattr(knn, "_chunked", counting)
    return total


def _sum_distances(values, q, c):
    unit = {a: v / np.linalg.norm(v, axis=1, keepdims=True) for a, v in values.items()}
    return sum(np.round(np.abs(1 - (unit[a] @ unit[a].T)[np.ix_([r[i] for r in q], [r[i] for r in c])]), 12) for i, a in enumerate(values))


def test_threshold_search_on_20000_combinations(spark, monkeypatch):
    """Same lists as comparing everything, ties included, for a small part of the pairs."""
    r = np.random.RandomState(3)
    values = {"a": r.normal(size=(160, 6)), "b": r.normal(size=(125, 6))}
    values["b"][100:] = values["b"][:25]  # equal vectors of different values: ties
    combos = [(i, j) for i in range(160) for j in range(125)]
    asked = [combos[i] for i in r.choice(len(combos), 60, replace=False)]
    emb = spark.createDataFrame([(n, str(i), v.tolist()) for n, vs in values.items() for i, v in enumerate(vs)], "attr string, value string, vec array<double>")
    rows = spark.createDataFrame([(100 * i + i // 7, i, j) for i, j in combos], "n long, a int, b int").withColumn("cid", F.col("a") * 1000 + F.col("b"))
    c = knn.with_vectors(rows, emb, ["a", "b"])
    q = knn.with_vectors(spark.createDataFrame([(k, i, j, 3 + k % 9) for k, (i, j) in enumerate(asked)], "qid int, a int, b int, want int"), emb, ["a", "b"])
    pairs = _count_pairs(monkeypatch)
    got = {}
    for x in knn.nearest(q, c, ["a", "b"], need=F.col("want")).collect():
        got.setdefault(x.qid, {})[x["rank"]] = (x.cid, x.dist)
    dist = _sum_distances(values, asked, combos)
    for k, (i, j) in enumerate(asked):
        others = [(round(d, 9), a * 1000 + b) for d, (a, b) in zip(dist[k], combos) if (a, b) != (i, j)]
        want = sorted(others)[: 3 + k % 9]
        assert [got[k][n][0] for n in range(1, len(want) + 1)] == [w[1] for w in want] and len(got[k]) == len(want)
    assert pairs[0] < 0.1 * len(asked) * len(combos)


def test_value_index_leaves_far_cells_out(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL", 50)
    r = np.random.RandomState(5)
    centres = r.normal(size=(20, 8)) * 3
    vecs = np.vstack([centres[r.randint(20, size=1500)] + r.normal(size=(1500, 8)) * 0.1, np.zeros((2, 8))])
    rows = [("x" if i % 4 else "y", f"v{i:04}", v.tolist()) for i, v in enumerate(vecs)]
    values = spark.createDataFrame(rows, "attr string, value string, vec array<double>").repartition(3)
    pairs = _count_pairs(monkeypatch)
    got = {}
    for x in knn.value_neighbours(values, 4).collect():
        got.setdefault((x.attr, x.value), {})[x["rank"]] = x.neighbour
    assert pairs[0] < 0.35 * sum(n * n for n in (sum(t[0] == a for t in rows) for a in "xy"))
    for a in "xy":
        own = [(v, np.array(x)) for n, v, x in rows if n == a]
        m = np.array([x for _, x in own])
        norms = np.linalg.norm(m, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            d = np.where(np.outer(norms, norms) > 0, 1 - (m @ m.T) / np.outer(norms, norms), 1.0)
        for i in list(range(0, len(own), 37)) + [len(own) - 1]:
            want = sorted((round(abs(d[i, j]), 10), own[j][0]) for j in range(len(own)) if j != i)[:4]
            assert [got[a, own[i][0]][k] for k in range(1, 5)] == [w[1] for w in want]


def test_never_together(spark):
    df = skewed(60)
    values = sorted(df.x.unique())
    got = set()
    for r in never_together(spark.createDataFrame(df), "key", "x").collect():
        stretch = [x for x in values if r["first"] <= x <= r["last"]]
        assert len(stretch) == r.n
        got |= {(r.key, x) for x in stretch}
    assert got == {(k, x) for k in df.key.unique() for x in values} - set(zip(df.key, df.x))


def test_roc_area(spark):
    r = np.random.RandomState(4)
    df = pd.DataFrame(dict(id=np.arange(300), score=np.round(r.normal(size=300), 1), negative_sample=(r.rand(300) < 0.3).astype(int)))
    points = pr_roc(spark.createDataFrame(df), "negative_sample", "id", chunks=6)
    s = df.sort_values(["score", "id"])
    tp, fp = s.negative_sample.cumsum(), (1 - s.negative_sample).cumsum()
    want = np.trapezoid(tp / tp.iloc[-1], fp / fp.iloc[-1])
    assert abs(roc_auc(points).first()[0] - want) < 1e-12


_NO_PRODUCT = ["q17_band_pairs", "q22_never_together", "q23_fuzzy_join", "q23_words_within", "q47_cpd_cat_unseen", "q11_relaxed_cpd"]
_NO_PRODUCT += ["q56_dictionary_prior", "q56_dictionary_near"]


@pytest.mark.parametrize("name", _NO_PRODUCT)
def test_no_product_of_tables(spark, name):
    from cpdspark.workload import registry

    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
