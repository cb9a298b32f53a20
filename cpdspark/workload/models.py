"""Queries on conditional distributions, neighbours, scoring, and ranking quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cpdspark.functions.vectors import cosine_similarity
from cpdspark.operators import beta, counts, cpd, cpd_embedding, knn, metrics, relaxed
from cpdspark.operators.bands import DIGITS
from cpdspark.operators.score import explain, most_improbable, score, score_row
from cpdspark.operators.vocabulary import (
    adaptive_dimension,
    encoded,
    pair_features,
    single_vocabulary,
    target_encoding,
    vocabulary,
)
from cpdspark.plans.catalogue import simple_rent
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
from cpdspark.workload.common import (
    line_id,
    part_embeddings,
    rounded,
    sql_distances,
    sql_embeddings,
    sql_normal,
    sql_smoothed,
    table,
)

QUERIES = {}
ORACLES = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


SOFT = ["p_brand", "p_type"]
_EMB = f"{sql_embeddings(SOFT)}, {sql_distances(SOFT)}"


# Conditional distributions -------------------------------------------------------------------


@register(
    "q47_cpd_cat",
    f"""WITH c AS (SELECT l_suppkey, l_returnflag, l_linestatus, count(*) AS c FROM lineitem GROUP BY 1, 2, 3),
    t AS (SELECT l_suppkey, l_returnflag, sum(c) AS n, count(*) AS seen FROM c GROUP BY 1, 2),
    d AS (SELECT count(DISTINCT l_linestatus) AS d FROM lineitem)
    SELECT l_suppkey, l_returnflag, l_linestatus, round({sql_smoothed('c', 'n', 'seen', 'd')}, 9) AS lp
    FROM c JOIN t USING (l_suppkey, l_returnflag), d""",
)
def q47(spark, sf):
    node = cat("l_linestatus", "l_suppkey", "l_returnflag")
    return rounded(cpd.categorical(table(spark, sf, "lineitem"), node).drop("support"), 9)


def _with_next(p: DataFrame, own: str, others: dict[str, int]) -> DataFrame:
    """Rows' own value with values of the parts some places further on: tuples that were mostly never seen."""
    out = p.select("p_partkey", own)
    for column, step in others.items():
        out = out.join(p.select((F.col("p_partkey") - step).alias("p_partkey"), column), "p_partkey")
    return out.drop("p_partkey")


@register(
    "q47_cpd_cat_unseen",
    f"""WITH asked AS (SELECT DISTINCT a.p_brand, b.p_name FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
    c AS (SELECT p_brand, p_name, count(*) AS c FROM part GROUP BY 1, 2),
    t AS (SELECT p_brand, sum(c) AS n, count(*) AS seen FROM c GROUP BY 1),
    d AS (SELECT count(DISTINCT p_name) AS d FROM part)
    SELECT a.p_brand, a.p_name, round({sql_smoothed('coalesce(c, 0)', 'n', 'seen', 'd')}, 9) AS lp
    FROM asked a LEFT JOIN c ON a.p_brand = c.p_brand AND a.p_name = c.p_name JOIN t ON a.p_brand = t.p_brand, d""",
)
def q47_unseen(spark, sf):
    p = table(spark, sf, "part")
    asked = _with_next(p, "p_brand", {"p_name": 1}).distinct()
    return rounded(cpd.categorical(p, cat("p_name", "p_brand"), asked).drop("support"), 9)


@register(
    "q47_cpd_cat_band",
    f"""WITH pl AS (SELECT DISTINCT p_brand, p_size, p_name FROM part),
    m AS (SELECT pl.p_brand, pl.p_size, pl.p_name, count(*) AS n, count(*) FILTER (p.p_name = pl.p_name) AS c,
      count(DISTINCT p.p_name) AS seen FROM pl JOIN part p ON p.p_brand = pl.p_brand AND abs(p.p_size - pl.p_size) <= 5
      GROUP BY 1, 2, 3), d AS (SELECT count(DISTINCT p_name) AS d FROM part)
    SELECT p_brand, p_size, p_name, round({sql_smoothed('c', 'n', 'seen', 'd')}, 9) AS lp FROM m, d""",
)
def q47_band(spark, sf):
    out = cpd.categorical(table(spark, sf, "part"), cat("p_name", "p_brand", band("p_size", 5)))
    size = F.round(F.col(cpd.POS) / 10.0**DIGITS).cast("int").alias("p_size")
    return rounded(out.select("p_brand", size, "p_name", "lp"), 9)


@register(
    "q48_cpd_num",
    """WITH g AS (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)
    SELECT c_nationkey, c_mktsegment, count(*)::BIGINT AS n,
      round(CASE WHEN count(*) <= 1 THEN any_value(g.m) ELSE avg(c_acctbal) END, 6) AS mean,
      round(CASE WHEN count(*) <= 1 THEN any_value(g.s) ELSE stddev_samp(c_acctbal) END, 6) AS std
    FROM customer, g GROUP BY 1, 2""",
)
def q48(spark, sf):
    return rounded(cpd.numerical(table(spark, sf, "customer"), num("c_acctbal", "c_nationkey", "c_mktsegment")))


_LINE_KEYS = "l_suppkey, l_returnflag, l_linestatus"
_LINE_BAND = f"""WITH p AS (SELECT {_LINE_KEYS}, l_quantity, count(*) AS n, sum(l_extendedprice) AS s1,
      sum(l_extendedprice * l_extendedprice) AS s2 FROM lineitem GROUP BY ALL),
    g AS (SELECT avg(l_extendedprice) AS gm, stddev_samp(l_extendedprice) AS gs FROM lineitem),
    m AS (SELECT {', '.join('a.' + k for k in _LINE_KEYS.split(', '))}, a.l_quantity, sum(b.n) AS n, sum(b.s1) AS s1,
      sum(b.s2) AS s2 FROM p a JOIN p b
      ON a.l_suppkey = b.l_suppkey AND a.l_returnflag = b.l_returnflag AND a.l_linestatus = b.l_linestatus
      AND abs(a.l_quantity - b.l_quantity) <= 4 GROUP BY ALL),
    st AS (SELECT {_LINE_KEYS}, l_quantity, n::BIGINT AS n, CASE WHEN n <= 1 THEN gm ELSE s1 / n END AS mean,
      CASE WHEN n <= 1 THEN gs ELSE sqrt(greatest(s2 - s1 * s1 / n, 0) / (n - 1)) END AS std FROM m, g)"""


@register("q48_cpd_num_band", f"{_LINE_BAND} SELECT {_LINE_KEYS}, l_quantity, n, round(mean * n, 4) AS total, round(std, 4) AS std FROM st")
def q48_band(spark, sf):
    node = num("l_extendedprice", "l_suppkey", "l_returnflag", "l_linestatus", band("l_quantity", 4))
    out = cpd.numerical(table(spark, sf, "lineitem"), node)
    quantity = (F.col(cpd.POS) / 10.0**DIGITS).alias("l_quantity")
    return rounded(out.select(*_LINE_KEYS.split(", "), quantity, "n", (F.col("mean") * F.col("n")).alias("total"), "std"), 4)


_EMB_BAND = f"""WITH {_EMB},
    pl AS (SELECT DISTINCT p_brand, p_type, p_size FROM part),
    cand AS (SELECT pl.p_brand, pl.p_type, pl.p_size, p.p_partkey AS id, p.p_retailprice AS y,
      (p.p_brand = pl.p_brand AND p.p_type = pl.p_type) AS hit, x.d + z.d AS d
      FROM pl JOIN part p ON abs(p.p_size - pl.p_size) <= 5
      JOIN dist_p_brand x ON x.a = pl.p_brand AND x.b = p.p_brand JOIN dist_p_type z ON z.a = pl.p_type AND z.b = p.p_type),
    rk AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type, p_size ORDER BY hit DESC, d, id) AS r FROM cand),
    st AS (SELECT p_brand, p_type, p_size, count(*)::BIGINT AS n, avg(y) AS mean, stddev_samp(y) AS std
      FROM rk WHERE hit OR r <= 15 GROUP BY 1, 2, 3)"""
_EMB_NUM = emb_num("p_retailprice", *SOFT, band("p_size", 5), k=15)


@register(
    "q49_cpd_emb_num",
    f"{_EMB_BAND} SELECT p_brand, p_type, p_size, n, round(mean, 6) AS mean, round(std, 6) AS std FROM st",
)
def q49_num(spark, sf):
    out = cpd_embedding.numerical(table(spark, sf, "part"), _EMB_NUM, part_embeddings(spark, sf, SOFT), "p_partkey")
    size = F.round(F.col(cpd.POS) / 10.0**DIGITS).cast("int").alias("p_size")
    return rounded(out.select(*SOFT, size, "n", "mean", "std"))


@register(
    "q49_cpd_emb_cat",
    f"""WITH {_EMB}, q AS (SELECT *, p_size % 3 AS pack FROM part),
    pl AS (SELECT DISTINCT p_brand, p_type, pack FROM q),
    cand AS (SELECT pl.p_brand, pl.p_type, pl.pack, q.p_partkey AS id, q.p_name AS v,
      (q.p_brand = pl.p_brand AND q.p_type = pl.p_type) AS hit, q.pack = pl.pack AS same_pack, x.d + z.d AS d
      FROM pl, q JOIN dist_p_brand x ON x.a = pl.p_brand AND x.b = q.p_brand
      JOIN dist_p_type z ON z.a = pl.p_type AND z.b = q.p_type),
    rk AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY p_brand, p_type, pack) AS nh,
      row_number() OVER (PARTITION BY p_brand, p_type, pack, hit ORDER BY d, id) AS r FROM cand WHERE hit OR same_pack),
    mem AS (SELECT * FROM rk WHERE hit OR r <= 15 - nh),
    c AS (SELECT p_brand, p_type, pack, v, count(*) AS c FROM mem GROUP BY ALL),
    t AS (SELECT p_brand, p_type, pack, sum(c) AS n, count(*) AS seen FROM c GROUP BY ALL),
    d AS (SELECT count(DISTINCT p_name) AS dd FROM part),
    asked AS (SELECT DISTINCT p_brand, p_type, pack, p_name FROM q)
    SELECT a.p_brand, a.p_type, a.pack, a.p_name, round({sql_smoothed('coalesce(c, 0)', 'n', 'seen', 'dd')}, 9) AS lp
    FROM asked a JOIN t USING (p_brand, p_type, pack)
    LEFT JOIN c ON c.p_brand = a.p_brand AND c.p_type = a.p_type AND c.pack = a.pack AND c.v = a.p_name, d""",
)
def q49_cat(spark, sf):
    p = table(spark, sf, "part").withColumn("pack", F.col("p_size") % 3)
    node = emb_cat("p_name", *SOFT, hard("pack"), k=15)
    out = cpd_embedding.categorical(p, node, part_embeddings(spark, sf, SOFT), "p_partkey")
    return rounded(out.select(*SOFT, "pack", "p_name", "lp"), 9)


@register(
    "q11_relaxed_cpd",
    f"""WITH x AS (SELECT DISTINCT a.p_brand, b.p_name, c.p_type FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1
      JOIN part c ON c.p_partkey = a.p_partkey + 2),
    asked AS (SELECT *, EXISTS (SELECT 1 FROM part p WHERE p.p_brand = x.p_brand AND p.p_name = x.p_name) AS both FROM x),
    m AS (SELECT a.p_brand, a.p_name, a.p_type, count(*) AS n, count(*) FILTER (p.p_type = a.p_type) AS c,
      count(DISTINCT p.p_type) AS seen FROM asked a JOIN part p ON p.p_brand = a.p_brand AND (NOT a.both OR p.p_name = a.p_name)
      GROUP BY 1, 2, 3), d AS (SELECT count(DISTINCT p_type) AS d FROM part)
    SELECT p_brand, p_name, p_type, round({sql_smoothed('c', 'n', 'seen', 'd')}, 9) AS lp FROM m, d""",
)
def q11_cpd(spark, sf):
    p = table(spark, sf, "part")
    asked = _with_next(p, "p_brand", {"p_name": 1, "p_type": 2}).distinct()
    node = cat("p_type", "p_brand", "p_name", strict=False)
    return rounded(relaxed.categorical(p, node, asked).drop("support"), 9)


@register(
    "q212_simple_rent",
    f"""WITH t AS (SELECT c_custkey, r_name AS state, n_name AS city, c_mktsegment AS zip, c_acctbal AS rent FROM customer
      JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
    d AS (SELECT count(DISTINCT state) AS ds, count(DISTINCT city) AS dc, count(DISTINCT zip) AS dz FROM t),
    cc AS (SELECT state, city, count(*) AS c FROM t GROUP BY ALL), ct AS (SELECT state, sum(c) AS n, count(*) AS seen FROM cc GROUP BY ALL),
    zc AS (SELECT city, zip, count(*) AS c FROM t GROUP BY ALL), zt AS (SELECT city, sum(c) AS n, count(*) AS seen FROM zc GROUP BY ALL),
    g AS (SELECT avg(rent) AS gm, stddev_samp(rent) AS gs FROM t),
    m AS (SELECT city, count(*) AS n, avg(rent) AS m, stddev_samp(rent) AS s FROM t GROUP BY ALL),
    l AS (SELECT c_custkey, -ln(ds) AS a, {sql_smoothed('cc.c', 'ct.n', 'ct.seen', 'dc')} AS b, {sql_smoothed('zc.c', 'zt.n', 'zt.seen', 'dz')} AS c,
      {sql_normal('rent', 'CASE WHEN m.n <= 1 THEN gm ELSE m END', 'CASE WHEN m.n <= 1 THEN gs ELSE s END')} AS e
      FROM t JOIN cc USING (state, city) JOIN ct USING (state) JOIN zc USING (city, zip) JOIN zt USING (city) JOIN m USING (city), d, g)
    SELECT c_custkey, round(b, 6) AS lp_city, round(c, 6) AS lp_zip, round(e, 6) AS lp_rent, round(a + b + c + e, 6) AS score FROM l""",
)
def q212(spark, sf):
    """A model of the catalogue, on customers renamed as its apartments."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    c = c.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rents = c.select(
        "c_custkey",
        F.col("r_name").alias("state"),
        F.col("n_name").alias("city"),
        F.col("c_mktsegment").alias("zip"),
        F.col("c_acctbal").alias("rent"),
    )
    out = score(rents, simple_rent(), "c_custkey")
    return rounded(out.select("c_custkey", "lp_city", "lp_zip", "lp_rent", "score"))


# Neighbours ----------------------------------------------------------------------------------


@register(
    "q18_lookup_vector",
    f"""WITH {sql_embeddings(SOFT)} SELECT p_partkey, len(x.vec)::INTEGER AS dim,
      round(list_sum(list_transform(range(1, len(x.vec) + 1), lambda i: i * (x.vec[i] + 2 * z.vec[i]))), 6) AS weighted
    FROM part JOIN emb x ON x.attr = 'p_brand' AND x.value = p_brand JOIN emb z ON z.attr = 'p_type' AND z.value = p_type""",
)
def q18(spark, sf):
    wide = knn.replace_with_vectors(table(spark, sf, "part"), part_embeddings(spark, sf, SOFT), SOFT, ["p_partkey"])
    terms = F.zip_with("p_brand", "p_type", lambda x, z: x + 2 * z)
    weighted = F.aggregate(F.transform(terms, lambda t, i: t * (i + 1)), F.lit(0.0), lambda total, t: total + t)
    return wide.select("p_partkey", F.size("p_brand").alias("dim"), F.round(weighted, 6).alias("weighted"))


def _places(p: DataFrame) -> DataFrame:
    return p.select(*SOFT).distinct().withColumn("qid", F.concat_ws("/", *SOFT))


@register(
    "q19_knn_rows",
    f"""WITH {_EMB}, pl AS (SELECT DISTINCT p_brand, p_type FROM part),
    cand AS (SELECT pl.p_brand || '/' || pl.p_type AS qid, p.p_partkey AS cid, x.d + z.d AS dist FROM pl, part p
      JOIN dist_p_brand x ON x.a = pl.p_brand AND x.b = p.p_brand JOIN dist_p_type z ON z.a = pl.p_type AND z.b = p.p_type
      WHERE p.p_brand <> pl.p_brand OR p.p_type <> pl.p_type)
    SELECT qid, cid, round(dist, 9) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, cid)::INTEGER AS rank
    FROM cand) WHERE rank <= 10""",
)
def q19(spark, sf):
    p, emb = table(spark, sf, "part"), part_embeddings(spark, sf, SOFT)
    q = knn.with_vectors(_places(p), emb, SOFT)
    c = knn.with_vectors(p.select(*SOFT, F.col("p_partkey").alias("cid")), emb, SOFT)
    return rounded(knn.nearest(q, c, SOFT, k=10), 9)


@register(
    "q20_knn_concat",
    f"""WITH {sql_embeddings(SOFT)}, v AS (SELECT p_brand, p_type, list_concat(x.vec, z.vec) AS vec
      FROM (SELECT DISTINCT p_brand, p_type FROM part) JOIN emb x ON x.attr = 'p_brand' AND x.value = p_brand
      JOIN emb z ON z.attr = 'p_type' AND z.value = p_type),
    cand AS (SELECT a.p_brand || '/' || a.p_type AS qid, b.p_brand || '/' || b.p_type AS cid,
      round(list_cosine_distance(a.vec, b.vec), 12) AS dist FROM v a, v b WHERE a.p_brand <> b.p_brand OR a.p_type <> b.p_type)
    SELECT qid, cid, round(dist, 9) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, cid)::INTEGER AS rank
    FROM cand) WHERE rank <= 5""",
)
def q20(spark, sf):
    places = _places(table(spark, sf, "part"))
    q = knn.with_vectors(places, part_embeddings(spark, sf, SOFT), SOFT)
    return rounded(knn.nearest(q, q.withColumnRenamed("qid", "cid"), SOFT, k=5, concatenated=True), 9)


@register(
    "q21_knn_values",
    f"""WITH {_EMB}, a AS (SELECT 'p_brand' AS attr, a AS value, b AS neighbour, d FROM dist_p_brand WHERE a <> b
      UNION ALL SELECT 'p_type', a, b, d FROM dist_p_type WHERE a <> b)
    SELECT attr, value, neighbour, round(d, 9) AS dist, rank FROM (SELECT *, row_number() OVER
      (PARTITION BY attr, value ORDER BY d, neighbour)::INTEGER AS rank FROM a) WHERE rank <= 5""",
)
def q21(spark, sf):
    return rounded(knn.value_neighbours(part_embeddings(spark, sf, SOFT), 5), 9)


@register(
    "q83_cosine",
    f"""WITH {sql_embeddings(SOFT)} SELECT p_partkey, round(1 - list_cosine_distance(x.vec, z.vec), 9) AS sim
    FROM part JOIN emb x ON x.attr = 'p_brand' AND x.value = p_brand JOIN emb z ON z.attr = 'p_type' AND z.value = p_type""",
)
def q83(spark, sf):
    wide = knn.with_vectors(table(spark, sf, "part").select("p_partkey", *SOFT), part_embeddings(spark, sf, SOFT), SOFT)
    sim = cosine_similarity(F.col(knn.vector_column("p_brand")), F.col(knn.vector_column("p_type")))
    return rounded(wide.select("p_partkey", sim.alias("sim")), 9)


_THREE = ["p_brand", "p_type", "p_name"]


@register(
    "q84_pair_features",
    f"""WITH {sql_embeddings(_THREE)} SELECT p_partkey, round(1 - list_cosine_distance(x.vec, z.vec), 9) AS sim_p_brand_p_type,
      round(1 - list_cosine_distance(x.vec, y.vec), 9) AS sim_p_brand_p_name,
      round(1 - list_cosine_distance(z.vec, y.vec), 9) AS sim_p_type_p_name, p_size
    FROM part JOIN emb x ON x.attr = 'p_brand' AND x.value = p_brand JOIN emb z ON z.attr = 'p_type' AND z.value = p_type
    JOIN emb y ON y.attr = 'p_name' AND y.value = p_name""",
)
def q84(spark, sf):
    emb = part_embeddings(spark, sf, _THREE)
    return rounded(pair_features(table(spark, sf, "part"), emb, _THREE, ["p_size"], keep=["p_partkey"]), 9)


# Scoring -------------------------------------------------------------------------------------

PART_SPEC = ModelSpec(
    (uniform("p_brand"), cat("p_type", "p_brand"), num("p_retailprice", "p_brand", "p_type")), "part_plain"
)
_PART_SCORE = f"""c AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS nb, count(*) OVER (PARTITION BY p_brand, p_type) AS nbt,
      avg(p_retailprice) OVER (PARTITION BY p_brand, p_type) AS m, stddev_samp(p_retailprice) OVER (PARTITION BY p_brand, p_type) AS s
      FROM part),
    seen AS (SELECT p_brand, count(DISTINCT p_type) AS seen FROM part GROUP BY 1),
    d AS (SELECT count(DISTINCT p_brand) AS db, count(DISTINCT p_type) AS dt, avg(p_retailprice) AS gm,
      stddev_samp(p_retailprice) AS gs FROM part),
    sc AS (SELECT p_partkey, p_brand, p_type, p_retailprice, -ln(db) AS lp_p_brand, {sql_smoothed('nbt', 'nb', 'seen', 'dt')} AS lp_p_type,
      {sql_normal('p_retailprice', 'CASE WHEN nbt <= 1 THEN gm ELSE m END', 'CASE WHEN nbt <= 1 THEN gs ELSE s END')} AS lp_p_retailprice
      FROM c JOIN seen USING (p_brand), d)"""


def flagship(spark, sf) -> DataFrame:
    scored = score(table(spark, sf, "part"), PART_SPEC, "p_partkey")
    worst = explain(most_improbable(scored, 50, "p_partkey"), PART_SPEC)
    return rounded(worst.select("p_partkey", "p_brand", "p_type", "p_retailprice", "score", "worst_attr", "worst_lp"))


@register(
    "q59_most_improbable",
    f"""WITH {_PART_SCORE}, t AS (SELECT *, lp_p_brand + lp_p_type + lp_p_retailprice AS score FROM sc ORDER BY score, p_partkey LIMIT 50)
    SELECT p_partkey, p_brand, p_type, p_retailprice, round(score, 6) AS score,
      CASE least(lp_p_brand, lp_p_type, lp_p_retailprice) WHEN lp_p_brand THEN 'p_brand' WHEN lp_p_retailprice THEN 'p_retailprice' ELSE 'p_type' END AS worst_attr,
      round(least(lp_p_brand, lp_p_type, lp_p_retailprice), 6) AS worst_lp FROM t""",
)
def q59(spark, sf):
    return flagship(spark, sf)


@register(
    "q62_explain",
    f"""WITH {_PART_SCORE} SELECT p_partkey,
      CASE least(lp_p_brand, lp_p_type, lp_p_retailprice) WHEN lp_p_brand THEN 'p_brand' WHEN lp_p_retailprice THEN 'p_retailprice' ELSE 'p_type' END AS worst_attr,
      round(least(lp_p_brand, lp_p_type, lp_p_retailprice), 6) AS worst_lp FROM sc""",
)
def q62(spark, sf):
    scored = explain(score(table(spark, sf, "part"), PART_SPEC, "p_partkey"), PART_SPEC)
    return rounded(scored.select("p_partkey", "worst_attr", "worst_lp"))


@register(
    "q61_score_row",
    f"""WITH {_PART_SCORE} SELECT p_partkey, round(lp_p_brand + lp_p_type + lp_p_retailprice, 6) AS score
    FROM sc ORDER BY p_retailprice DESC, p_partkey LIMIT 1""",
)
def q61(spark, sf):
    p = table(spark, sf, "part")
    row = p.orderBy(F.desc("p_retailprice"), "p_partkey").first().asDict()
    return rounded(score_row(p, PART_SPEC, "p_partkey", row).select("p_partkey", "score"))


LINE_SPEC = ModelSpec(
    (
        uniform("l_returnflag"),
        cat("l_linestatus", "l_returnflag"),
        cat("l_suppkey", "l_returnflag", "l_linestatus"),
        num("l_quantity", "l_suppkey", "l_returnflag", "l_linestatus"),
        num("l_extendedprice", "l_suppkey", "l_returnflag", "l_linestatus", band("l_quantity", 4)),
    ),
    "line_plain",
)


def line_scores(spark, sf) -> DataFrame:
    """The five-node model over all order lines (headline of the benchmark)."""
    columns = ["l_returnflag", "l_linestatus", "l_suppkey", "l_quantity", "l_extendedprice"]
    lines = line_id(table(spark, sf, "lineitem")).select("line_id", *columns)
    return score(lines, LINE_SPEC, "line_id")


@register(
    "q58_score_plain",
    f"""{_LINE_BAND},
    r AS (SELECT l_orderkey * 10 + l_linenumber AS line_id, {_LINE_KEYS}, l_quantity, l_extendedprice,
      count(*) OVER (PARTITION BY l_returnflag) AS nf, count(*) OVER (PARTITION BY l_returnflag, l_linestatus) AS nfs,
      count(*) OVER (PARTITION BY {_LINE_KEYS}) AS nk, avg(l_quantity) OVER (PARTITION BY {_LINE_KEYS}) AS qm,
      stddev_samp(l_quantity) OVER (PARTITION BY {_LINE_KEYS}) AS qs FROM lineitem),
    sf AS (SELECT l_returnflag, count(DISTINCT l_linestatus) AS seen_s FROM lineitem GROUP BY 1),
    sk AS (SELECT l_returnflag, l_linestatus, count(DISTINCT l_suppkey) AS seen_k FROM lineitem GROUP BY 1, 2),
    d AS (SELECT count(DISTINCT l_returnflag) AS df, count(DISTINCT l_linestatus) AS ds, count(DISTINCT l_suppkey) AS dk,
      avg(l_quantity) AS gqm, stddev_samp(l_quantity) AS gqs FROM lineitem),
    sc AS (SELECT line_id, -ln(df) AS a, {sql_smoothed('nfs', 'nf', 'seen_s', 'ds')} AS b, {sql_smoothed('nk', 'nfs', 'seen_k', 'dk')} AS c,
      {sql_normal('l_quantity', 'CASE WHEN nk <= 1 THEN gqm ELSE qm END', 'CASE WHEN nk <= 1 THEN gqs ELSE qs END')} AS q,
      {sql_normal('l_extendedprice', 'mean', 'std')} AS e
      FROM r JOIN sf USING (l_returnflag) JOIN sk USING (l_returnflag, l_linestatus) JOIN st USING ({_LINE_KEYS}, l_quantity), d)
    SELECT line_id, round(b, 6) AS lp_l_linestatus, round(c, 6) AS lp_l_suppkey, round(q, 6) AS lp_l_quantity,
      round(e, 6) AS lp_l_extendedprice, round(a + b + c + q + e, 6) AS score FROM sc""",
)
def q58(spark, sf):
    lps = ["lp_l_linestatus", "lp_l_suppkey", "lp_l_quantity", "lp_l_extendedprice"]
    return rounded(line_scores(spark, sf).select("line_id", *lps, "score"))


@register(
    "q58_score_no_rules",
    f"""WITH d AS (SELECT count(DISTINCT c_nationkey) AS dn, count(DISTINCT c_mktsegment) AS dm, avg(c_acctbal) AS gm, stddev_samp(c_acctbal) AS gs FROM customer),
    w AS (SELECT *, count(*) OVER k AS n, avg(c_acctbal) OVER k AS m, stddev_samp(c_acctbal) OVER k AS s FROM customer
      WINDOW k AS (PARTITION BY c_nationkey, c_mktsegment))
    SELECT c_custkey, round(-ln(dn) - ln(dm) +
      {sql_normal('c_acctbal', 'CASE WHEN n <= 1 THEN gm ELSE m END', 'CASE WHEN n <= 1 THEN gs ELSE s END')}, 6) AS score FROM w, d""",
)
def q58_no_rules(spark, sf):
    spec = ModelSpec(
        (uniform("c_nationkey"), uniform("c_mktsegment"), num("c_acctbal", "c_nationkey", "c_mktsegment")), "customer"
    )
    return rounded(score(table(spark, sf, "customer"), spec, "c_custkey").select("c_custkey", "score"))


@register(
    "q58_score_roots",
    """WITH d AS (SELECT count(*)::DOUBLE AS n, max(o_totalprice) - min(o_totalprice) AS w,
      avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS p FROM orders)
    SELECT o_orderkey, round(ln(count(*) OVER (PARTITION BY o_orderpriority) / n) - ln(w)
      + CASE WHEN o_orderstatus = 'F' THEN ln(p) ELSE ln(1 - p) END, 6) AS score FROM orders, d""",
)
def q58_roots(spark, sf):
    o = table(spark, sf, "orders").withColumn("is_final", (F.col("o_orderstatus") == "F").cast("int"))
    spec = ModelSpec((freq("o_orderpriority"), uniform_cont("o_totalprice"), bernoulli("is_final")), "orders_roots")
    return rounded(score(o, spec, "o_orderkey").select("o_orderkey", "score"))


PART_EMB_SPEC = ModelSpec(
    (uniform("p_brand"), emb_cat("p_type", "p_brand", k=1), uniform("p_size"), _EMB_NUM), "part_embedding"
)


@register(
    "q58_score_emb",
    f"""{_EMB_BAND}, c AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS nb, count(*) OVER (PARTITION BY p_brand, p_type) AS nbt FROM part),
    seen AS (SELECT p_brand, count(DISTINCT p_type) AS seen FROM part GROUP BY 1),
    d AS (SELECT count(DISTINCT p_brand) AS db, count(DISTINCT p_type) AS dt, count(DISTINCT p_size) AS dz FROM part)
    SELECT p_partkey, round(-ln(db) - ln(dz) + {sql_smoothed('nbt', 'nb', 'seen', 'dt')}
      + {sql_normal('p_retailprice', 'mean', 'std')}, 6) AS score
    FROM c JOIN seen USING (p_brand) JOIN st USING (p_brand, p_type, p_size), d""",
)
def q58_emb(spark, sf):
    emb = part_embeddings(spark, sf, SOFT)
    return rounded(score(table(spark, sf, "part"), PART_EMB_SPEC, "p_partkey", emb).select("p_partkey", "score"))


@register(
    "q60_score_new_rows",
    f"""WITH t AS (SELECT s_nationkey, count(*) AS n, avg(s_acctbal) AS m, stddev_samp(s_acctbal) AS s FROM supplier GROUP BY 1),
    g AS (SELECT count(*)::DOUBLE AS total, avg(s_acctbal) AS gm, stddev_samp(s_acctbal) AS gs FROM supplier)
    SELECT c_custkey, round(CASE WHEN n IS NULL THEN '-inf'::DOUBLE ELSE ln(n / total) END +
      {sql_normal('c_acctbal', 'CASE WHEN coalesce(n, 0) <= 1 THEN gm ELSE m END', 'CASE WHEN coalesce(n, 0) <= 1 THEN gs ELSE s END')}, 6) AS score
    FROM customer LEFT JOIN t ON s_nationkey = c_nationkey, g""",
)
def q60(spark, sf):
    obs = table(spark, sf, "supplier").withColumnRenamed("s_suppkey", "c_custkey")
    spec = ModelSpec((freq("s_nationkey"), num("s_acctbal", "s_nationkey")), "supplier")
    names = {"c_nationkey": "s_nationkey", "c_acctbal": "s_acctbal"}
    scored = score(obs, spec, "c_custkey", rows=table(spark, sf, "customer"), rename=names)
    return rounded(scored.select("c_custkey", "score"))


# Ranking quality -----------------------------------------------------------------------------

_RANKED = """r AS (SELECT doc_id, lang, n_chars::DOUBLE AS score, toxic::BIGINT AS label FROM documents JOIN labels USING (doc_id)),
    k AS (SELECT *, sum(label) OVER w AS tp, sum(1 - label) OVER w AS fp, sum(label) OVER () AS p, sum(1 - label) OVER () AS n
      FROM r WINDOW w AS (ORDER BY score, doc_id))"""


def _ranked(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.col("n_chars").cast("double").alias("score"))
    return docs.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id")


@register(
    "q34_precision_at_k",
    f"""WITH {_RANKED} SELECT (tp + fp)::BIGINT AS k, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / p::DOUBLE, 9) AS recall
    FROM k WHERE tp + fp = p""",
)
def q34(spark, sf):
    return rounded(metrics.precision_at_k(_ranked(spark, sf), "toxic", "doc_id"), 9)


@register(
    "q63_pr_roc",
    f"""WITH {_RANKED} SELECT doc_id, round(tp / (tp + fp)::DOUBLE, 9) AS precision, round(tp / p::DOUBLE, 9) AS recall,
      round(fp / n::DOUBLE, 9) AS fpr FROM k""",
)
def q63(spark, sf):
    points = metrics.pr_roc(_ranked(spark, sf), "toxic", "doc_id")
    return rounded(points.select("doc_id", "precision", "recall", "fpr"), 9)


@register(
    "q35_auc",
    f"""WITH {_RANKED}, q AS (SELECT tp / p::DOUBLE AS y, fp / n::DOUBLE AS x, row_number() OVER (ORDER BY score, doc_id) AS i FROM k)
    SELECT round(sum((x - px) * (y + py) / 2), 9) AS auc FROM
      (SELECT x, y, lag(x) OVER (ORDER BY i) AS px, lag(y) OVER (ORDER BY i) AS py FROM q)""",
)
def q35(spark, sf):
    return rounded(metrics.roc_auc(metrics.pr_roc(_ranked(spark, sf), "toxic", "doc_id")), 9)


@register("q36_base_rate", "SELECT round(avg(toxic::DOUBLE), 9) AS base_rate FROM labels")
def q36(spark, sf):
    return rounded(metrics.base_rate(table(spark, sf, "labels"), "toxic"), 9)


@register(
    "q37_sweep",
    """WITH r AS (SELECT doc_id, lang, n_chars AS score, toxic AS label FROM documents JOIN labels USING (doc_id)),
    k AS (SELECT *, sum(label) OVER w AS tp, sum(1 - label) OVER w AS fp, sum(label) OVER (PARTITION BY lang) AS p,
      sum(1 - label) OVER (PARTITION BY lang) AS n FROM r WINDOW w AS (PARTITION BY lang ORDER BY score, doc_id)),
    q AS (SELECT lang, tp / nullif(p, 0)::DOUBLE AS y, fp / nullif(n, 0)::DOUBLE AS x, row_number() OVER (PARTITION BY lang ORDER BY score, doc_id) AS i FROM k)
    SELECT lang, round(coalesce(sum((x - px) * (y + py) / 2), 0), 9) AS auc FROM
      (SELECT lang, x, y, lag(x) OVER (PARTITION BY lang ORDER BY i) AS px, lag(y) OVER (PARTITION BY lang ORDER BY i) AS py FROM q)
    GROUP BY lang""",
)
def q37(spark, sf):
    points = metrics.pr_roc(_ranked(spark, sf), "toxic", "doc_id", by=["lang"])
    return rounded(metrics.roc_auc(points, by=["lang"]), 9)


# Older estimators ----------------------------------------------------------------------------


@register(
    "q50_beta_mean",
    "SELECT p_name, round(count(*)::DOUBLE / (SELECT count(*) FROM part), 9) AS prob FROM part GROUP BY 1",
)
def q50(spark, sf):
    return rounded(beta.occurrence(table(spark, sf, "part"), "p_name"), 9)


@register("q50_beta_sample")
def q50_sample(spark, sf):
    return rounded(beta.occurrence(table(spark, sf, "part"), "p_name", mode="sample", seed=5), 9)


def _sql_dependency(care_global: bool, seen_count: str, unseen: str) -> str:
    """Probability of every brand/name pair by brute force over the whole domain."""
    g = "* (gn / (SELECT count(*) FROM part)::DOUBLE)" if care_global else ""
    return f"""WITH d AS (SELECT count(DISTINCT p_name)::DOUBLE AS d FROM part),
    a AS (SELECT b.p_brand, n.p_name, n.gn FROM (SELECT DISTINCT p_brand FROM part) b,
      (SELECT p_name, count(*) AS gn FROM part GROUP BY 1) n),
    c AS (SELECT p_brand, p_name, count(*) AS c FROM part GROUP BY 1, 2),
    l AS (SELECT a.p_brand, a.p_name, gn, c, CASE WHEN c IS NULL THEN {unseen} ELSE {seen_count} END AS loc
      FROM a LEFT JOIN c ON a.p_brand = c.p_brand AND a.p_name = c.p_name, d),
    w AS (SELECT *, loc / sum(loc) OVER (PARTITION BY p_brand) AS part, loc / sum(loc) OVER (PARTITION BY p_brand) {g} AS w FROM l),
    pr AS (SELECT *, w / sum(w) OVER (PARTITION BY p_brand) AS prob, part / sum(w) OVER (PARTITION BY p_brand) AS share FROM w),
    un AS (SELECT *, max(CASE WHEN c IS NULL THEN share END) OVER (PARTITION BY p_brand) AS unseen FROM pr)
    SELECT p_brand, p_name, round(prob, 9) AS prob, round(unseen, 9) AS unseen_prob FROM un WHERE c IS NOT NULL"""


@register("q51_functional_dependency", _sql_dependency(True, "c::DOUBLE", "1.0::DOUBLE"))
def q51(spark, sf):
    out = beta.functional_dependency(table(spark, sf, "part"), "p_brand", "p_name", care_global=True)
    return rounded(out, 9)


@register("q52_co_occurrence_beta", _sql_dependency(False, "10 * d * ln(d)", "ln(d)"))
def q52(spark, sf):
    out = beta.co_occurrence(table(spark, sf, "part"), ["p_brand"], "p_name")
    return rounded(out, 9)


@register("q52_co_occurrence_counted", _sql_dependency(True, "100.0::DOUBLE * c", "1.0::DOUBLE"))
def q52_counted(spark, sf):
    out = beta.co_occurrence(table(spark, sf, "part"), ["p_brand"], "p_name", care_global=True, counted=True)
    return rounded(out, 9)


@register(
    "q53_numerical_dependency",
    """WITH g AS (SELECT avg(p_retailprice) AS gm, stddev_samp(p_retailprice) AS gs FROM part)
    SELECT p_brand, p_name, count(*)::BIGINT AS n, round((avg(p_retailprice) + any_value(gm)) / 2, 6) AS mean,
      round((coalesce(stddev_samp(p_retailprice), 1) + any_value(gs)) / 2, 6) AS std FROM part, g GROUP BY 1, 2""",
)
def q53(spark, sf):
    out = beta.numerical_dependency(table(spark, sf, "part"), ["p_brand", "p_name"], "p_retailprice", care_global=True)
    return rounded(out)


@register(
    "q54_dependency_ensemble",
    f"""WITH m AS (SELECT *, avg(p_retailprice) OVER (PARTITION BY p_brand) AS a, avg(p_retailprice) OVER (PARTITION BY p_type) AS b,
      avg(p_retailprice) OVER (PARTITION BY p_brand, p_type) AS c FROM part),
    e AS (SELECT *, (a + b + c) / 3 AS em, greatest(list_stddev_samp([a, b, c]), 0.0001::DOUBLE) AS es FROM m)
    SELECT p_partkey, round(em, 6) AS ens_mean, round(es, 6) AS ens_std,
      round(CASE WHEN p_retailprice < 0 THEN -66 ELSE {sql_normal('p_retailprice', 'em', 'es')} END, 6) AS lp FROM e""",
)
def q54(spark, sf):
    out = beta.dependency_ensemble(table(spark, sf, "part"), [["p_brand"], ["p_type"], ["p_brand", "p_type"]], "p_retailprice")
    return rounded(out.select("p_partkey", "ens_mean", "ens_std", "lp"))


_MIX = {
    "a": ("p_brand", "na / (2.0::DOUBLE * (na + nb))"),
    "b": ("p_type", "nb / (2.0::DOUBLE * (na + nb))"),
    "ab": ("p_brand, p_type", "0.5::DOUBLE"),
}


@register(
    "q55_mixture",
    "WITH m AS (SELECT *, "
    + ", ".join(
        f"count(*) OVER (PARTITION BY {k}) AS n{t}, avg(p_retailprice) OVER (PARTITION BY {k}) AS m{t}, "
        f"coalesce(stddev_samp(p_retailprice) OVER (PARTITION BY {k}), 0.5) AS s{t}"
        for t, (k, _) in _MIX.items()
    )
    + " FROM part) SELECT p_partkey, round(ln("
    + " + ".join(f"{w} * exp({sql_normal('p_retailprice', 'm' + t, 's' + t)})" for t, (_, w) in _MIX.items())
    + "), 6) AS lp FROM m",
)
def q55(spark, sf):
    out = beta.source_mixture(table(spark, sf, "part"), "p_brand", "p_type", "p_retailprice")
    return rounded(out.select("p_partkey", "lp"))


@register(
    "q57_population_prior",
    """WITH n AS (SELECT n_regionkey, c_nationkey, count(*) AS size FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)
    SELECT n_regionkey, c_nationkey, round(sum(size) OVER (PARTITION BY n_regionkey)::DOUBLE / sum(size) OVER (), 9) AS group_share,
      round(size::DOUBLE / sum(size) OVER (PARTITION BY n_regionkey), 9) AS item_share FROM n""",
)
def q57(spark, sf):
    joined = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return rounded(beta.population_prior(joined.withColumn("one", F.lit(1)), "n_regionkey", "c_nationkey", "one"), 9)


# Vocabularies --------------------------------------------------------------------------------

_LONG = """(SELECT DISTINCT 'p_brand' AS attr, p_brand AS value FROM part UNION SELECT DISTINCT 'p_type', p_type FROM part
    UNION SELECT DISTINCT 'p_name', p_name FROM part)"""


@register("q81_vocabulary", f"SELECT attr, value, row_number() OVER (PARTITION BY attr ORDER BY value) - 1 AS code FROM {_LONG}")
def q81(spark, sf):
    return vocabulary(table(spark, sf, "part"), _THREE)


@register("q82_single_vocabulary", f"SELECT attr, value, dense_rank() OVER (ORDER BY value) - 1 AS code FROM {_LONG}")
def q82(spark, sf):
    return single_vocabulary(table(spark, sf, "part"), _THREE)


@register(
    "q81_encoded",
    """SELECT p_partkey, dense_rank() OVER (ORDER BY p_brand) - 1 AS p_brand, dense_rank() OVER (ORDER BY p_type) - 1 AS p_type FROM part""",
)
def q81_encoded(spark, sf):
    p = table(spark, sf, "part")
    return encoded(p, vocabulary(p, SOFT), SOFT).select("p_partkey", *SOFT)


@register(
    "q87_target_encoding",
    """SELECT 'p_brand' AS attr, p_brand AS value, count(*)::BIGINT AS n, round(avg(p_retailprice), 7) AS encoding FROM part GROUP BY 2
    UNION ALL SELECT 'p_name', p_name, count(*)::BIGINT, round(avg(p_retailprice), 7) FROM part GROUP BY 2""",
)
def q87(spark, sf):
    return rounded(target_encoding(table(spark, sf, "part"), ["p_brand", "p_name"], "p_retailprice"), 7)


@register(
    "q88_adaptive_dimension",
    """SELECT count(DISTINCT l_partkey)::BIGINT AS n_values,
      least(100, floor(pow(count(DISTINCT l_partkey)::DOUBLE, 0.25))::BIGINT)::BIGINT AS dim FROM lineitem""",
)
def q88(spark, sf):
    return adaptive_dimension(table(spark, sf, "lineitem"), "l_partkey", 100)
