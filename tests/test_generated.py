import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window, functions as F

from cpdspark.functions import distributions as dist
from cpdspark.operators import beta, cpd, cumulative, fuzzy, inject, repair, synth, vocabulary
from cpdspark.operators.metrics import precision_at_k
from cpdspark.operators.score import most_improbable, score
from cpdspark.plans.catalogue import CATALOGUE
from cpdspark.plans.spec import Kind, ModelSpec, Node, Parent, Role, band, cat, emb_num, freq, num, uniform
from cpdspark.sources import embeddings as emb_files, tables
from tests.test_score import make, vectors


def test_spec_checks():
    with pytest.raises(ValueError):
        Parent("x", Role.BAND)
    with pytest.raises(ValueError):
        Node("x", Kind.CAT)
    with pytest.raises(ValueError):
        emb_num("x", "y", k=0)
    with pytest.raises(ValueError):
        ModelSpec((cat("a", "b"), cat("b", "a")))
    with pytest.raises(ValueError):
        ModelSpec((cat("a", "b"),))
    with pytest.raises(ValueError):
        num("x", band("a", 1), band("b", 1))
    assert [n.attr for n in ModelSpec((cat("a", "b"), uniform("b"))).topological()] == ["b", "a"]
    assert len([build() for build in CATALOGUE.values()]) == 17


def test_densities(spark):
    one = spark.range(1)
    val = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert abs(val(dist.normal(lit(1.0), lit(0.0), lit(1.0))) + 0.5 + 0.9189385332046727) < 1e-12
    assert np.isnan(val(dist.normal(lit(1.0), lit(1.0), lit(0.0))))
    assert val(dist.half_normal(lit(-1.0), lit(0.0), lit(1.0))) == -66
    assert val(dist.uniform_continuous(lit(5.0), lit(0.0), lit(4.0))) == -np.inf
    assert val(dist.bernoulli(lit(True), lit(0.0))) == -np.inf
    assert val(dist.edit_error(lit(60))) == -np.inf
    assert abs(np.exp(val(dist.edit_error(lit(0)))) - 0.95) < 1e-9
    assert abs(val(dist.log_sum_exp([lit(-1000.0), lit(-1000.0)])) + 1000 - np.log(2)) < 1e-9


def test_distribution_sums_to_one(spark):
    df = spark.createDataFrame(make())
    node = cat("year", "city", band("space", 10))
    places = cpd.with_position(df, node).select("city", cpd.POS).distinct()
    asked = places.crossJoin(df.select("year").distinct())
    total = cpd.categorical(df, node, asked).groupBy("city", cpd.POS).agg(F.sum(F.exp("lp")).alias("t"))
    assert total.filter(F.abs(F.col("t") - 1) > 1e-9).count() == 0


def test_injected_rows_never_fit(spark):
    df = make(300)[["id", "state", "city", "year", "rent"]]
    sdf = spark.createDataFrame(df)
    out = inject.inject_errors(sdf, "id", "city", ["state", "year", "rent"], 0.3, 1, share=0.1, shift={"rent": 2000.0})
    again = inject.inject_errors(sdf.repartition(5), "id", "city", ["state", "year", "rent"], 0.3, 1, share=0.1, shift={"rent": 2000.0})
    bad = out.filter("negative_sample = 1").toPandas().sort_values("id").reset_index(drop=True)
    pd.testing.assert_frame_equal(bad, again.filter("negative_sample = 1").toPandas().sort_values("id").reset_index(drop=True))
    assert len(bad) == 30 and (bad.id < 0).all()
    seen = {(c, a, v) for a in ["state", "year"] for c, v in zip(df.city, df[a])}
    full = df.groupby("city").year.nunique() == df.year.nunique()
    for r in bad.itertuples():
        wrong = (r.city, "state", r.state) not in seen or (r.city, "year", r.year) not in seen or r.rent > 1500
        assert wrong or full[r.city]  # a cell stays where its city has every value


def test_detection_beats_chance(spark):
    df = make(300)[["id", "state", "city", "year", "rent"]]
    sdf = spark.createDataFrame(df)
    bad = inject.inject_errors(sdf, "id", "city", ["state", "rent"], 0.5, 2, share=0.1, shift={"rent": 2000.0})
    spec = ModelSpec((uniform("city"), cat("state", "city"), num("rent", "state")))
    got = precision_at_k(score(bad, spec, "id", keep=["negative_sample"]), "negative_sample", "id").first()
    assert got["k"] == 30 and got["precision"] == got["recall"] and got["precision"] > 0.6


def test_precision_without_a_labelled_row(spark):
    """Every state occurs with every city, so that no copy is harmed and no row is labelled."""
    df = spark.createDataFrame([(i, f"c{i % 4}", f"s{i // 4 % 3}", float(i % 7)) for i in range(84)], "id int, city string, state string, rent double")
    bad = inject.inject_errors(df, "id", "city", ["state"], 0.5, 2, share=0.1)
    spec = ModelSpec((uniform("city"), cat("state", "city"), num("rent", "state")))
    scored = score(bad, spec, "id", keep=["negative_sample"])
    got = precision_at_k(scored, "negative_sample", "id").collect()
    assert [tuple(r) for r in got] == [(0, None, None)]
    by = precision_at_k(scored.withColumn("part", F.col("id") % 2), "negative_sample", "id", by=["part"])
    assert {r["k"] for r in by.collect()} == {0}


def test_sampled_repair_tends_to_exact(spark):
    df = make(200)
    df.loc[3, ["state", "city", "rent"]] = ["A", "B1", 900.0]
    sdf = spark.createDataFrame(df)
    spec = ModelSpec((freq("state"), cat("city", "state"), num("rent", "state")))
    suspects = sdf.filter("id = 3")
    exact = repair.repair_exact(suspects, sdf, spec, "id", "state", 3).toPandas()
    assert exact.loc[exact["rank"] == 1, "state"].item() == "B"
    assert exact.posterior.sum() <= 1 + 1e-9
    _, emb = vectors(spark, df, ["state"])
    many = sdf.filter("id = 3").drop("id").crossJoin(spark.range(60).withColumnRenamed("id", "id"))
    drawn = repair.repair_sampled(many, sdf, spec, "id", "state", emb, 1, 40, 5).toPandas()
    top = exact.set_index("state").posterior["B"]
    assert abs((drawn.state == "B").mean() - top) < 0.25


def test_proposal_sums_to_one(spark):
    _, emb = vectors(spark, make(), ["city"])
    got = repair.proposal(emb, 2).groupBy("value").agg(F.sum(F.col("prob") * F.col("n")), F.sum((F.col("weight") == 5).cast("int"))).collect()
    assert all(abs(r[1] - 1) < 1e-9 and r[2] == 2 for r in got)


def test_simulate_and_impute(spark):
    df = make(200)
    sdf = spark.createDataFrame(df)
    spec = ModelSpec(
        (freq("state"), cat("city", "state"), num("space", "city", greater_zero=True), cat("year", "city", band("space", 10)))
    )
    out = synth.simulate(sdf, spec, 300, 4, "id").toPandas()
    assert len(out) == 300 and not out.isna().any().any() and (out.space >= 0).all()
    share = (out.state == "A").mean()
    assert abs(share - (df.state == "A").mean()) < 0.1
    fits = [c.startswith(s) for s, c in zip(out.state, out.city)]
    assert np.mean(fits) > 0.8
    rows = sdf.filter("id < 12").drop("state")
    got = synth.impute(rows, sdf, spec, "id", ["state"], 30, 6).toPandas().set_index("id")
    truth = df.set_index("id").loc[got.index]
    assert (got.state == truth.state).mean() > 0.8


def _shares_against_score(spark, obs, spec, places, target, emb=None, n=4000):
    """Draws of ``target`` at fixed places against the probabilities that scoring gives every value there."""
    values = [r[0] for r in obs.select(target).distinct().collect()]
    cols = list(places[0])
    kinds = ", ".join(f"{c} {obs.schema[c].dataType.simpleString()}" for c in cols)
    at = spark.createDataFrame([tuple(p.values()) for p in places], kinds).withColumn("_place", F.monotonically_increasing_id())
    at = at.withColumn("_place", F.row_number().over(Window.orderBy("_place")) - 1).cache()
    rows = at.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("id", (F.col("_place") * n + F.col("_i")).cast("long"))
    drawn = synth.sample_nodes(rows.drop("_i"), obs, spec, [target], 5, "id", emb)
    share = {(r["_place"], r[target]): r["count"] / n for r in drawn.groupBy("_place", target).count().collect()}
    asked = at.crossJoin(spark.createDataFrame([(v,) for v in values], f"{target} {obs.schema[target].dataType.simpleString()}"))
    asked = asked.withColumn("id", F.row_number().over(Window.orderBy("_place", target)).cast("long"))
    scored = score(obs, spec, "id", emb, rows=asked, keep=["_place", target], only=[target]).collect()
    p = {(r["_place"], r[target]): float(np.exp(r[f"lp_{target}"])) for r in scored}
    assert set(share) <= set(p) and abs(sum(p.values()) - len(places)) < 1e-6
    worst = max(abs(share.get(k, 0.0) - x) for k, x in p.items())
    assert worst < 4.5 * np.sqrt(0.25 / n), worst
    return p, share


def test_draws_have_the_probabilities_that_score_gives(spark, monkeypatch):
    monkeypatch.setattr(synth, "FAN", 3)
    r = np.random.RandomState(6)
    rows = [(i, "ab"[i % 2], int(r.randint(40)), f"v{r.randint(9)}") for i in range(60)] + [(60, "c", 500, "w")]
    obs = spark.createDataFrame(rows, "id long, k string, x int, v string")
    spec = ModelSpec((freq("k"), freq("x"), cat("v", "k", band("x", 4))))
    places = [{"k": "a", "x": 7}, {"k": "b", "x": 30}, {"k": "a", "x": 20}, {"k": "c", "x": 498}, {"k": "c", "x": 3}]
    p, share = _shares_against_score(spark, obs, spec, places, "v")
    unseen = [k for k, x in p.items() if 0 < x < 0.1 / 1.1 and k in share]
    assert unseen  # unseen values are drawn

    loose = ModelSpec((freq("k"), freq("x"), cat("v", "k", band("x", 4), strict=False)))
    _shares_against_score(spark, obs, loose, [{"k": "a", "x": 7}, {"k": "c", "x": 3}, {"k": "nobody", "x": 30}, {"k": "nobody", "x": 4000}], "v")


def test_banded_embedded_draws_borrow_neighbours(spark):
    from cpdspark.plans.spec import emb_cat

    r = np.random.RandomState(8)
    rows = [(i, f"k{i % 5}", int(r.randint(30)), f"v{r.randint(6)}") for i in range(80)]
    obs = spark.createDataFrame(rows, "id long, k string, x int, v string")
    emb = spark.createDataFrame([("k", f"k{i}", r.normal(size=4).tolist()) for i in range(5)], "attr string, value string, vec array<double>")
    spec = ModelSpec((freq("k"), freq("x"), emb_cat("v", "k", band("x", 5), k=8)))
    places = [{"k": "k0", "x": 7}, {"k": "k3", "x": 29}, {"k": "k1", "x": 0}]
    _shares_against_score(spark, obs, spec, places, "v", emb)


def test_simulate_in_bands_of_several_chunks(spark, monkeypatch):
    r = np.random.RandomState(5)
    df = spark.createDataFrame(pd.DataFrame(dict(id=np.arange(300), a=r.choice(list("xyz"), 300), size=r.randint(1, 30, 300), b=r.choice([f"b{i:02d}" for i in range(40)], 300))))
    spec = ModelSpec((uniform("a"), freq("size"), cat("b", "a", band("size", 2))))
    one = synth.simulate(df, spec, 80, 3, "id").orderBy("id").collect()
    monkeypatch.setattr(cumulative, "POINTS_PER_CHUNK", 60)
    assert synth.simulate(df, spec, 80, 3, "id").orderBy("id").collect() == one and len(one) == 80


def test_simulate_with_neighbours(spark):
    df = make(120)
    _, emb = vectors(spark, df, ["state", "city"])
    from cpdspark.plans.spec import emb_cat

    spec = ModelSpec((uniform("state"), emb_cat("city", "state", k=30), emb_num("rent", "city", k=25)))
    out = synth.simulate(spark.createDataFrame(df), spec, 60, 8, "id", emb).toPandas()
    assert len(out) == 60 and not out.isna().any().any()


def test_sources(spark, tmp_path):
    df = make(40)
    sdf = spark.createDataFrame(df)
    tables.write_csv(sdf, str(tmp_path / "t"))
    back = tables.read_csv(spark, str(tmp_path / "t"), sdf.schema.simpleString()[7:-1].replace(":", " "))
    assert back.exceptAll(sdf).count() == 0 and back.count() == 40
    vals, emb = vectors(spark, df, ["city", "year"])
    prefix = str(tmp_path / "run_")
    emb_files.write_pairs(emb, ["city", "year"], prefix)
    got = {(r.attr, r.value): np.array(r.vec) for r in emb_files.read_pairs(spark, ["city", "year"], prefix).collect()}
    assert got.keys() == vals.keys()
    assert all(np.array_equal(got[k], vals[k]) for k in vals)


def test_scenarios(spark, tmp_path):
    sdf = spark.createDataFrame(make(80)[["id", "city", "year"]]).withColumn("year", (F.col("id") + 1900).cast("int"))
    out = inject.scenarios(sdf, "id", "city", ["year"], [0.1], [0.5, 1.0], 3)
    assert {r[0]: r[1] for r in out.groupBy("scenario").count().collect()} == {"k=0.1,p=0.5": 88, "k=0.1,p=1.0": 88}
    tables.write_scenarios(out, str(tmp_path / "s"))
    sized = inject.scenarios(sdf, "id", "city", ["year"], [0.1], [0.5], 3, sizes=[20, 50])
    assert {r[0]: r[1] for r in sized.groupBy("scenario").count().collect()} == {"s=20,k=0.1,p=0.5": 22, "s=50,k=0.1,p=0.5": 55}


def test_grid_is_one_plan(spark):
    """Each scenario equals its own injection, and more cells take no more jobs."""
    sdf = spark.createDataFrame(make(120)[["id", "city", "state", "year"]]).repartition(3)
    shares, ps = [0.05, 0.2], [0.1, 0.6, 1.0]

    def jobs(group, run):
        spark.sparkContext.setJobGroup(group, group)
        rows = run().collect()
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return rows, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    one, few = jobs("one-cell", lambda: inject.scenarios(sdf, "id", "city", ["state", "year"], shares[:1], ps[:1], 3, sizes=[50]))
    out, many = jobs("all-cells", lambda: inject.scenarios(sdf, "id", "city", ["state", "year"], shares, ps, 3, sizes=[50, 90, None]))
    assert many <= few + 2  # the rows of a size that differ at most in how a broadcast is made
    for k in shares:
        for p in ps:
            alone = inject.inject_errors(sdf, "id", "city", ["state", "year"], p, 3, share=k)
            assert sorted(map(tuple, alone.collect())) == sorted(tuple(r)[:-1] for r in out if r.scenario == f"k={k},p={p}")
    small = {r.id for r in out if r.scenario.startswith("s=50") and r.id >= 0}
    assert len(small) == 50 and small < {r.id for r in out if r.scenario.startswith("s=90")}
    assert sorted(map(tuple, one)) == sorted(tuple(r) for r in out if r.scenario == "s=50,k=0.05,p=0.1")


def test_fuzzy_slices_find_all(spark):
    r = np.random.RandomState(7)
    words = sorted({"".join(r.choice(list("ab"), r.randint(1, 9))) for _ in range(60)} | {"", "a", "bab", "abab", "aab" * 4})
    sdf = spark.createDataFrame([(w,) for w in [*words, None, "a"]], "w string")
    far = sdf.dropna().distinct()
    far = far.crossJoin(far.toDF("l")).select("w", "l", F.levenshtein("w", "l").alias("d")).cache()
    for d in (0, 1, 2, 4):
        got = {tuple(x) for x in fuzzy.nearest_words(sdf, "w", sdf, d).collect()}
        assert got == {tuple(x) for x in far.filter(F.col("d") <= d).collect()}


def test_learnt_vectors_tell_good_from_bad(spark):
    df = make(300)[["state", "city", "rent"]]
    rows = inject.training_set(spark.createDataFrame(df), "city", ["rent"], 30, 5)
    emb, weights = vocabulary.learn_embeddings(rows, ["state", "city"], ["rent"], "good", 4, 12, 9, rate=2.0)
    sims = vocabulary.pair_features(rows, emb, ["state", "city"], ["rent"], keep=["good"], normalize=False)
    means = {r[0]: r[1] for r in sims.groupBy("good").agg(F.avg("sim_state_city")).collect()}
    assert weights["sim_state_city"] * (means[1] - means[0]) > 0.1


def test_beta_unseen_mass(spark):
    df = spark.createDataFrame(make(100))
    out = beta.functional_dependency(df, "city", "year").toPandas()
    n_years = df.select("year").distinct().count()
    for _, g in out.groupby("city"):
        rest = (n_years - len(g)) * (g.unseen_prob.iloc[0] if len(g) < n_years else 0)
        assert abs(g.prob.sum() + rest - 1) < 1e-9


def test_planted_rows_are_found(spark):
    """One very high and one very low value, and a city under a wrong state."""
    df = make(200)
    df.loc[0, "rent"] = 9000.0
    df.loc[1, "rent"] = -4000.0
    df.loc[2, "state"] = {"A": "B", "B": "C", "C": "A"}[df.loc[2, "state"]]
    spec = ModelSpec((uniform("state"), cat("city", "state"), num("rent", "city")))
    worst = most_improbable(score(spark.createDataFrame(df), spec, "id"), 3, "id").toPandas()
    assert set(worst.id) == {0, 1, 2}


def test_repair_gives_points_no_density(spark):
    """Where all rows of a candidate have one number, any other number rules the candidate out."""
    rows = [(i, "a", 11.0 + (i % 4 - 1.5)) for i in range(8)] + [(i, "b", 50.0) for i in (8, 9)]
    rows += [(i, "c", 22.0 + i) for i in range(10, 13)]
    obs = spark.createDataFrame(rows, "id long, k string, y double")
    spec = ModelSpec((uniform("k"), num("y", "k")))
    suspect = spark.createDataFrame([(99, "a", 30.0), (98, "a", 50.0)], obs.schema)
    got = {(r.id, r.rank): r for r in repair.repair_exact(suspect, obs, spec, "id", "k", 3).collect()}
    assert got[99, 1].k == "c" and got[99, 3].k == "b" and got[99, 3].posterior == 0.0
    assert got[98, 1].k == "b"
    drawn = synth.impute(suspect, obs, spec, "id", ["k"], 40, 3)
    assert {r.id: r.k for r in drawn.collect()}[99] == "c"


def test_repair_by_classes_equals_the_whole_domain(spark, monkeypatch):
    """400 values, of which a suspect's parents support a few: same top values and posteriors from few rows."""
    r = np.random.RandomState(11)
    rows = [(i, f"k{i % 6}", f"v{(i * 7) % 40:03}", float(r.normal(10 * (i % 6), 2)), int(r.randint(50))) for i in range(240)]
    rows += [(1000 + i, "far", f"w{i:03}", 500.0, 900) for i in range(360)]
    obs = spark.createDataFrame(rows, "id long, k string, v string, y double, z int")
    spec = ModelSpec((freq("k"), cat("v", "k"), num("y", "k", "v"), cat("z", "k", "v", band("y", 3.0))))
    suspects = obs.filter("id in (0, 7, 31, 100)").unionByName(spark.createDataFrame([(-1, "new", "v001", 3.0, 5), (-2, "k1", "v001", -90.0, 900)], obs.schema))
    rows = repair.candidate_classes(suspects.select("id", *spec.attrs), obs, spec, "id", "v", 3)
    assert rows.count() < 6 * 60 and {x[0] for x in rows.groupBy("id").agg(F.sum("times")).select("sum(times)").collect()} == {400}
    few = repair.repair_exact(suspects, obs, spec, "id", "v", 3).orderBy("id", "rank").collect()
    monkeypatch.setattr(repair, "_equal_keys", lambda *_: None)
    every = repair.repair_exact(suspects, obs, spec, "id", "v", 3).orderBy("id", "rank").collect()
    assert [(x.id, x.v, x.present, x["rank"]) for x in few] == [(x.id, x.v, x.present, x["rank"]) for x in every]
    assert np.allclose([x.posterior for x in few], [x.posterior for x in every], atol=1e-12)
    plan = repair.repair_exact(suspects, obs, spec, "id", "v", 3)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan  # the ranking keeps three rows before it shuffles


def test_sampled_evidence_tends_to_the_exact_one(spark):
    """Three missing columns, one of them a parent of both others."""
    r = np.random.RandomState(13)
    rows = [(i, f"a{i % 3}", f"b{(i + i // 9) % 4}", f"c{r.randint(3)}", float(r.normal(i % 3, 1))) for i in range(150)]
    obs = spark.createDataFrame(rows, "id long, aa string, bb string, cc string, y double")
    spec = ModelSpec((freq("aa"), cat("bb", "aa"), cat("cc", "aa", "bb"), num("y", "bb", "cc")))
    asked = spark.createDataFrame([(1, 0.5), (2, 2.5)], "id long, y double")
    exact = {x.id: x.log_evidence for x in synth.evidence(asked, obs, spec, "id", ["aa", "bb", "cc"]).collect()}
    # by enumeration, every combination scored on its own
    grid = asked.crossJoin(obs.select("aa").distinct()).crossJoin(obs.select("bb").distinct()).crossJoin(obs.select("cc").distinct())
    scored = score(obs, spec, "id", rows=grid).groupBy("id").agg(F.log(F.sum(F.exp("score"))).alias("e")).collect()
    assert all(abs(exact[x.id] - x.e) < 1e-9 for x in scored)
    order = {x.id: x.log_evidence for x in synth.evidence(asked, obs, spec, "id", ["cc", "aa", "bb"]).collect()}
    assert all(abs(order[i] - exact[i]) < 1e-9 for i in exact)
    drawn = synth.impute(asked, obs, spec, "id", ["aa", "bb", "cc"], 3000, 4).collect()
    assert all(abs(x.log_evidence - exact[x.id]) < 0.15 for x in drawn)


def test_only_harmed_copies_are_labelled(spark):
    rows = [(i, "p" if i % 2 else "q", ["x", "y"][i // 2 % 2], f"only-{i % 2}-{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, pivot string, everywhere string, own string")
    for force in ("random", "last"):
        out = inject.inject_errors(df, "id", "pivot", ["own", "everywhere"], 0.0, 5, n=30, force=force)
        bad = out.filter("negative_sample = 1").collect()
        assert len(bad) == 30 and all(r.own.split("-")[1] != ("1" if r.pivot == "p" else "0") for r in bad)
    out = inject.inject_errors(df, "id", "pivot", ["everywhere"], 1.0, 5, n=30)
    assert out.filter("negative_sample = 1").count() == 0


def test_all_errors_asked_for_are_injected(spark, caplog):
    """Pivot value ``hot`` has met every value, ``rare`` has not; then both have."""
    rows = [(i, "hot", f"v{i % 4}", i % 3) for i in range(48)] + [(48 + i, "rare", "v0", 0) for i in range(4)]
    df = spark.createDataFrame(rows, "id long, pivot string, a string, b int")
    for force in ("random", "last"):
        bad = inject.inject_errors(df, "id", "pivot", ["a", "b"], 0.2, 5, n=30, force=force).filter("id < 0").collect()
        assert len(bad) == 30 and all(r.negative_sample == 1 and r.pivot == "rare" and (r.a, r.b) != ("v0", 0) for r in bad)
    full = df.filter("pivot = 'hot'")
    out = inject.inject_errors(full, "id", "pivot", ["a", "b"], 0.2, 5, share=0.25)
    copies = out.filter("id < 0").collect()
    assert len(copies) == 12 and all(r.negative_sample == 0 for r in copies) and out.count() == 60
    assert {(r.a, r.b) for r in copies} <= {(r[2], r[3]) for r in rows} and "0 of 12 errors" in caplog.text


def test_beta_draws():
    from cpdspark.functions.gamma import beta_draws

    state = np.arange(40_000, dtype=np.uint64)
    for a, b in ((1.0, 1.0), (0.3, 2.0), (5.0, 2.0), (40.0, 900.0), (0.05, 0.05)):
        x = beta_draws(np.full(len(state), a), np.full(len(state), b), state)
        mean, var = a / (a + b), a * b / (a + b) ** 2 / (a + b + 1)
        assert abs(x.mean() - mean) < 5 * np.sqrt(var / len(x)) and abs(x.var() / var - 1) < 0.06
        again = beta_draws(np.full(3, a), np.full(3, b), state[[7, 5, 7]])
        assert (again == x[[7, 5, 7]]).all()
    assert beta_draws([2.0, 0.0], [0.0, 3.0], [1, 2]).tolist() == [1.0, 0.0]
