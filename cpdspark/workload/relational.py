"""Queries on filters, joins, counts, and scalar distributions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cpdspark.functions import distributions as dist
from cpdspark.functions.lineage import shared_folder
from cpdspark.operators import bands, counts, filters, fuzzy, metrics, synth
from cpdspark.sources.embeddings import read_pairs, write_pairs
from cpdspark.sources.tables import query, read_csv, write_csv
from cpdspark.workload.common import part_embeddings, rounded, sql_embeddings, sql_normal, sql_unit, table

QUERIES = {}
ORACLES = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


def _new_folder(spark) -> str:
    return f"{shared_folder(spark)}/written-{uuid.uuid4().hex}"


@register("q01_csv_round_trip", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part WHERE p_size > 10")
def q01(spark, sf):
    """Writes a result as CSV with a header, and reads it with its schema."""
    out = table(spark, sf, "part").filter("p_size > 10").select("p_partkey", "p_name", "p_size", "p_retailprice")
    folder = _new_folder(spark)
    write_csv(out, folder)
    return read_csv(spark, folder, "p_partkey long, p_name string, p_size int, p_retailprice double")


@register(
    "q02_embedding_pair_round_trip",
    f"""WITH {sql_embeddings(["p_brand", "p_type"])}
    SELECT attr, value, i::INTEGER AS i, vec[i + 1] AS x FROM emb, range(64) r(i)""",
)
def q02(spark, sf):
    """Writes value embeddings as pairs of text files, and pairs their lines again."""
    folder, attrs = _new_folder(spark), ["p_brand", "p_type"]
    write_pairs(part_embeddings(spark, sf, attrs), attrs, f"{folder}/run_")
    return read_pairs(spark, attrs, f"{folder}/run_").select("attr", "value", F.posexplode("vec").alias("i", "x"))


@register(
    "q05_sql_view",
    "SELECT p_brand, count(*)::BIGINT AS n, round(avg(p_retailprice), 6) AS mean_price FROM part WHERE p_size > 10 GROUP BY p_brand",
)
def q05(spark, sf):
    out = query(
        spark,
        "SELECT p_brand, count(*) AS n, avg(p_retailprice) AS mean_price FROM cpd_part WHERE p_size > 10 GROUP BY p_brand",
        cpd_part=table(spark, sf, "part"),
    )
    return rounded(out)


@register("q06_projection", "SELECT p_partkey, p_brand, p_type FROM part")
def q06(spark, sf):
    return table(spark, sf, "part").select(*["p_partkey", "p_brand", "p_type"])


@register("q07_filter", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def q07(spark, sf):
    return table(spark, sf, "orders").filter(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@register("q08_isin", "SELECT p_partkey FROM part WHERE p_type IN ('SMALL', 'PROMO')")
def q08(spark, sf):
    return table(spark, sf, "part").filter(filters.value_mask("p_type", ["SMALL", "PROMO"])).select("p_partkey")


@register("q09_band", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE abs(l_quantity - 25) <= 3")
def q09(spark, sf):
    return table(spark, sf, "lineitem").filter(filters.band_mask("l_quantity", 25, 3)).select("l_orderkey", "l_linenumber")


@register(
    "q10_mixed_conjunction",
    "SELECT p_partkey FROM part WHERE p_brand = 'Brand#3' AND abs(p_size - 20) <= 8 AND p_type <> 'SMALL'",
)
def q10(spark, sf):
    masks = [filters.value_mask("p_brand", ["Brand#3"]), filters.band_mask("p_size", 20, 8), F.col("p_type") != "SMALL"]
    return table(spark, sf, "part").filter(filters.conjunction(masks)).select("p_partkey")


@register(
    "q11_relaxed_filter",
    """WITH a AS (SELECT * FROM part WHERE p_brand = 'Brand#3'),
    b AS (SELECT * FROM a WHERE p_type = 'NO SUCH TYPE' OR NOT EXISTS (SELECT 1 FROM a WHERE p_type = 'NO SUCH TYPE')),
    c AS (SELECT * FROM b WHERE abs(p_size - 20) <= 8 OR NOT EXISTS (SELECT 1 FROM b WHERE abs(p_size - 20) <= 8))
    SELECT p_partkey FROM c""",
)
def q11(spark, sf):
    masks = [
        filters.value_mask("p_brand", ["Brand#3"]),
        filters.value_mask("p_type", ["NO SUCH TYPE"]),
        filters.band_mask("p_size", 20, 8),
    ]
    return filters.relaxed_filter(table(spark, sf, "part"), masks).select("p_partkey")


@register("q12_without_labels", "SELECT doc_id, quality FROM labels WHERE toxic = 0")
def q12(spark, sf):
    return filters.without_labels(table(spark, sf, "labels"), "toxic").select("doc_id", "quality")


@register("q13_pop_target", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def q13(spark, sf):
    return filters.pop_target(table(spark, sf, "supplier"), "s_acctbal")[0]


@register(
    "q14_cells",
    """SELECT p_partkey, 'p_brand' AS attr, p_brand AS value FROM part
    UNION ALL SELECT p_partkey, 'p_type', p_type FROM part
    UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part""",
)
def q14(spark, sf):
    return filters.cells(table(spark, sf, "part"), "p_partkey", ignore=["p_name", "p_retailprice"])


@register("q15_read_back", "SELECT p_partkey, p_type, CAST(p_size AS VARCHAR) AS p_size FROM part")
def q15(spark, sf):
    return filters.read_back(filters.cells(table(spark, sf, "part"), "p_partkey"), "p_partkey", ["p_type", "p_size"])


@register(
    "q16_equi_matches",
    """SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_suppkey, l_returnflag)::BIGINT AS matches
    FROM lineitem""",
)
def q16(spark, sf):
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag")
    return counts.equi_matches(li, ["l_suppkey", "l_returnflag"]).select("l_orderkey", "l_linenumber", "matches")


@register(
    "q17_band_pairs",
    """SELECT a.p_partkey AS left_key, count(*)::BIGINT AS pairs, round(avg(b.p_retailprice), 6) AS mean_price,
      min(b.p_retailprice) AS low, max(b.p_retailprice) AS high FROM part a JOIN part b
    ON a.p_brand = b.p_brand AND a.p_type = b.p_type AND abs(a.p_size - b.p_size) <= 5 GROUP BY 1""",
)
def q17(spark, sf):
    """What each row's partners of the equi and band join come to; the pairs themselves are never formed."""
    p = table(spark, sf, "part").withColumn("pos", bands.grid(F.col("p_size")))
    keys, centre = ["p_brand", "p_type"], p.agg(F.avg("p_retailprice")).scalar()
    placed = p.withColumn("_c", centre)
    points = bands.moment_points(placed, [*keys, "_c"], "pos", "p_retailprice", F.col("_c"))
    found = bands.band_moments(points, points.select(*keys, "_c", "pos"), [*keys, "_c"], "pos", bands.grid_radius(5))
    mean, _ = bands.mean_std(F.col("_c"))
    stats = found.select(*keys, "pos", F.col("n").alias("pairs"), F.round(mean, 6).alias("mean_price"), "lo", "hi")
    out = p.join(stats, [*keys, "pos"])
    return out.select(F.col("p_partkey").alias("left_key"), "pairs", "mean_price", F.col("lo").alias("low"), F.col("hi").alias("high"))


@register(
    "q17_band_counts",
    """WITH p AS (SELECT l_suppkey, l_quantity, count(*) AS n FROM lineitem GROUP BY 1, 2)
    SELECT a.l_suppkey, a.l_quantity, sum(b.n)::BIGINT AS matches FROM p a JOIN p b
    ON a.l_suppkey = b.l_suppkey AND abs(a.l_quantity - b.l_quantity) <= 4 GROUP BY 1, 2""",
)
def q17b(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", "l_quantity", bands.grid(F.col("l_quantity")).alias("pos"))
    points = li.groupBy("l_suppkey", "pos").agg(F.count(F.lit(1)).alias("n"))
    out = bands.band_counts(points, points, ["l_suppkey"], "pos", bands.grid_radius(4))
    return out.select("l_suppkey", (F.col("pos") / 10.0**bands.DIGITS).alias("l_quantity"), F.col("n").alias("matches"))


@register(
    "q22_never_together",
    """WITH d AS (SELECT v, row_number() OVER (ORDER BY v) AS i FROM (SELECT DISTINCT p_name AS v FROM part)),
    missing AS (SELECT b.p_brand, d.v, d.i, d.i - row_number() OVER (PARTITION BY b.p_brand ORDER BY d.i) AS run
      FROM (SELECT DISTINCT p_brand FROM part) b CROSS JOIN d
      WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_brand = b.p_brand AND p.p_name = d.v))
    SELECT p_brand, min(v) AS first, max(v) AS last, count(*)::BIGINT AS n FROM missing GROUP BY p_brand, run""",
)
def q22(spark, sf):
    return counts.never_together(table(spark, sf, "part"), "p_brand", "p_name")


@register(
    "q23_fuzzy_join",
    """SELECT t.listed AS word, w.word AS listed, levenshtein(w.word, t.listed)::INTEGER AS distance
    FROM (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS word FROM part) w
    JOIN (SELECT DISTINCT lower(p_type) AS listed FROM part) t ON levenshtein(w.word, t.listed) <= 4""",
)
def q23(spark, sf):
    p = table(spark, sf, "part")
    listed = p.select(F.explode(F.split("p_name", " ")).alias("listed"))
    return fuzzy.nearest_words(p.select(F.lower("p_type").alias("type")), "type", listed, 4)


@register(
    "q23_words_within",
    """SELECT a.word, b.word AS listed, levenshtein(a.word, b.word)::INTEGER AS distance
    FROM (SELECT DISTINCT p_name AS word FROM part) a JOIN (SELECT DISTINCT p_name AS word FROM part) b
    ON levenshtein(a.word, b.word) <= 2""",
)
def q23b(spark, sf):
    p = table(spark, sf, "part")
    return fuzzy.nearest_words(p, "p_name", p.select("p_name"), 2)


@register(
    "q24_synonym",
    """WITH syn AS (SELECT v AS keyword, 'group ' || length(v) AS synonym FROM
        (SELECT DISTINCT split_part(p_name, ' ', 2) AS v FROM part)),
    kw AS (SELECT p_partkey, i AS pos, string_split(p_name, ' ')[i] AS keyword FROM part, range(1, 3) t(i)),
    hit AS (SELECT p_partkey, kw.keyword, synonym, row_number() OVER (PARTITION BY p_partkey ORDER BY pos) AS rn
        FROM kw JOIN syn ON kw.keyword = syn.keyword)
    SELECT p_partkey, keyword, synonym FROM hit WHERE rn = 1""",
)
def q24(spark, sf):
    p = table(spark, sf, "part")
    second = F.split("p_name", " ")[1]
    synonyms = p.select(second.alias("keyword")).distinct()
    synonyms = synonyms.withColumn("synonym", F.concat(F.lit("group "), F.length("keyword").cast("string")))
    return fuzzy.first_synonym(p, "p_partkey", "p_name", synonyms, " ")


@register("q26_domain", "SELECT DISTINCT p_name FROM part")
def q26(spark, sf):
    return counts.domain(table(spark, sf, "part"), "p_name")


@register(
    "q27_frequency",
    """SELECT l_suppkey, l_returnflag, count(*)::BIGINT AS n, round(count(*) / (SELECT count(*) FROM lineitem)::DOUBLE, 9) AS share
    FROM lineitem GROUP BY 1, 2""",
)
def q27(spark, sf):
    return rounded(counts.frequency(table(spark, sf, "lineitem"), "l_suppkey", "l_returnflag"), 9)


@register("q28_co_occurrence", "SELECT p_brand, p_type, p_name, count(*)::BIGINT AS n FROM part GROUP BY 1, 2, 3")
def q28(spark, sf):
    return counts.co_occurrence(table(spark, sf, "part"), ["p_brand", "p_type"], "p_name")


@register("q29_collected", "SELECT p_brand, p_name, count(*)::BIGINT AS n FROM part GROUP BY 1, 2")
def q29(spark, sf):
    return counts.collected(table(spark, sf, "part"), "p_brand", "p_name")


@register(
    "q30_cond_moments",
    """WITH g AS (SELECT avg(l_extendedprice) AS m, stddev_samp(l_extendedprice) AS s FROM lineitem)
    SELECT l_suppkey, l_quantity, count(*)::BIGINT AS n,
      round(CASE WHEN count(*) <= 1 THEN any_value(g.m) ELSE avg(l_extendedprice) END, 7) AS mean,
      round(CASE WHEN count(*) <= 1 THEN any_value(g.s) ELSE stddev_samp(l_extendedprice) END, 7) AS std
    FROM lineitem, g GROUP BY 1, 2""",
)
def q30(spark, sf):
    return rounded(counts.conditional_moments(table(spark, sf, "lineitem"), ["l_suppkey", "l_quantity"], "l_extendedprice"), 7)


@register("q31_support", "SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
def q31(spark, sf):
    return counts.support(table(spark, sf, "orders"), "o_totalprice")


@register(
    "q32_top_values",
    "SELECT p_name, count(*)::BIGINT AS n FROM part GROUP BY p_name ORDER BY n DESC, p_name LIMIT 10",
)
def q32(spark, sf):
    return counts.top_values(table(spark, sf, "part"), "p_name", 10)


@register(
    "q33_boolean_rate",
    "SELECT c_nationkey, round(avg(CASE WHEN c_acctbal > 0 THEN 1.0::DOUBLE ELSE 0 END), 9) AS rate FROM customer GROUP BY 1",
)
def q33(spark, sf):
    return rounded(counts.boolean_rate(table(spark, sf, "customer"), F.col("c_acctbal") > 0, "c_nationkey"), 9)


@register(
    "q38_uniform",
    "SELECT p_partkey, round(-ln((SELECT count(DISTINCT p_name) FROM part)), 9) AS lp FROM part",
)
def q38(spark, sf):
    p = table(spark, sf, "part")
    size = counts.domain_size(p, "p_name")
    return rounded(p.select("p_partkey", dist.uniform_categorical(size).alias("lp")), 9)


@register(
    "q39_frequency_root",
    """SELECT p_partkey, round(ln(count(*) OVER (PARTITION BY p_name)::DOUBLE / (SELECT count(*) FROM part)), 9) AS lp
    FROM part""",
)
def q39(spark, sf):
    p = table(spark, sf, "part")
    shares = counts.frequency(p, "p_name").select("p_name", dist.safe_ln(F.col("share")).alias("lp"))
    return rounded(p.join(shares, "p_name").select("p_partkey", "lp"), 9)


@register(
    "q40_named_categorical",
    """WITH w AS (SELECT p_type, sum(p_size)::DOUBLE AS weight FROM part GROUP BY 1)
    SELECT p_partkey, round(ln(weight / (SELECT sum(weight) FROM w)), 9) AS lp FROM part JOIN w USING (p_type)""",
)
def q40(spark, sf):
    p = table(spark, sf, "part")
    weights = p.groupBy("p_type").agg(F.sum("p_size").alias("weight"))
    total = weights.agg(F.sum("weight")).scalar()
    lp = dist.named_categorical(F.col("weight"), F.col("_t"))
    return rounded(p.join(weights, "p_type", "left").withColumn("_t", total).select("p_partkey", lp.alias("lp")), 9)


@register(
    "q41_uniform_continuous",
    """SELECT c_custkey, round(CASE WHEN c_acctbal BETWEEN lo AND hi THEN -ln(hi - lo) ELSE '-inf'::DOUBLE END, 9) AS lp
    FROM customer, (SELECT min(s_acctbal) AS lo, max(s_acctbal) AS hi FROM supplier)""",
)
def q41(spark, sf):
    span = table(spark, sf, "supplier").agg(F.struct(F.min("s_acctbal").alias("lo"), F.max("s_acctbal").alias("hi"))).scalar()
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal").withColumn("_s", span)
    return rounded(c.select("c_custkey", dist.uniform_continuous(F.col("c_acctbal"), F.col("_s.lo"), F.col("_s.hi")).alias("lp")), 9)


_EVENT_MOMENTS = "(SELECT event_type, avg(value) AS m, stddev_samp(value) AS s FROM events GROUP BY 1)"


def _event_moments(spark, sf):
    e = table(spark, sf, "events")
    stats = e.groupBy("event_type").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    return e.join(stats, "event_type")


@register(
    "q42_normal",
    f"SELECT event_id, round({sql_normal('value', 'm', 's')}, 9) AS lp FROM events JOIN {_EVENT_MOMENTS} USING (event_type)",
)
def q42(spark, sf):
    lp = dist.normal(F.col("value"), F.col("m"), F.col("s"))
    return rounded(_event_moments(spark, sf).select("event_id", lp.alias("lp")), 9)


@register(
    "q43_half_normal",
    f"""SELECT c_custkey, round(CASE WHEN c_acctbal < 0 THEN -66 ELSE {sql_normal('c_acctbal', 'm', 's')} END, 9) AS lp
    FROM customer, (SELECT avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer)""",
)
def q43(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    g = c.agg(F.struct(F.avg("c_acctbal").alias("m"), F.stddev_samp("c_acctbal").alias("s"))).scalar()
    lp = dist.half_normal(F.col("c_acctbal"), F.col("_g.m"), F.col("_g.s"))
    return rounded(c.withColumn("_g", g).select("c_custkey", lp.alias("lp")), 9)


@register(
    "q44_log_normal",
    """SELECT o_orderkey, round(-(ln(o_totalprice) - m) * (ln(o_totalprice) - m) / (2.0 * s * s)
      - 0.5 * ln(2.0 * pi()) - ln(o_totalprice * s), 9) AS lp
    FROM orders, (SELECT avg(ln(o_totalprice)) AS m, stddev_samp(ln(o_totalprice)) AS s FROM orders)""",
)
def q44(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    x = F.ln("o_totalprice")
    g = o.agg(F.struct(F.avg(x).alias("m"), F.stddev_samp(x).alias("s"))).scalar()
    lp = dist.log_normal(F.col("o_totalprice"), F.col("_g.m"), F.col("_g.s"))
    return rounded(o.withColumn("_g", g).select("o_orderkey", lp.alias("lp")), 9)


@register(
    "q45_bernoulli",
    """WITH r AS (SELECT avg(CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0 END) AS p FROM orders)
    SELECT o_orderkey, round(CASE WHEN o_orderstatus = 'F' THEN ln(p) ELSE ln(1 - p) END, 9) AS lp FROM orders, r""",
)
def q45(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").alias("flag"))
    rate = o.agg(F.avg(F.col("flag").cast("double"))).scalar()
    return rounded(o.withColumn("_p", rate).select("o_orderkey", dist.bernoulli(F.col("flag"), F.col("_p")).alias("lp")), 9)


@register(
    "q46_edit_error",
    """WITH top AS (SELECT p_name AS intended FROM part GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    SELECT p_partkey, round(levenshtein(p_name, intended) * ln(0.05::DOUBLE)
      - ln((SELECT sum(pow(0.05::DOUBLE, i)) FROM range(50) t(i))), 9) AS lp FROM part, top""",
)
def q46(spark, sf):
    p = table(spark, sf, "part")
    intended = counts.top_values(p, "p_name", 1).agg(F.first("p_name")).scalar()
    d = F.levenshtein("p_name", "intended")
    return rounded(p.withColumn("intended", intended).select("p_partkey", dist.edit_error(d).alias("lp")), 9)


@register(
    "q64_first_n_per_key",
    """SELECT l_orderkey, l_linenumber, l_suppkey FROM (SELECT *, row_number() OVER
      (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber) AS i FROM lineitem)
    WHERE i <= 30 AND l_extendedprice > 100 AND abs(l_quantity - 25) < 20""",
)
def q64(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("line", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    keep = (F.col("l_extendedprice") > 100) & (F.abs(F.col("l_quantity") - 25) < 20)
    return synth.first_n_per_key(li, "l_suppkey", "line", 30, keep).select("l_orderkey", "l_linenumber", "l_suppkey")


@register(
    "q66_shuffle_key",
    f"SELECT p_partkey, row_number() OVER (ORDER BY {sql_unit(11, 'p_partkey')}, p_partkey)::BIGINT AS place FROM part",
)
def q66(spark, sf):
    """The place of every row in the shuffled table."""
    return metrics.shuffled_places(table(spark, sf, "part").select("p_partkey"), "p_partkey", 11)


@register(
    "q68_value_difference",
    """SELECT DISTINCT p_name FROM part WHERE p_brand <> 'Brand#1'
    EXCEPT SELECT DISTINCT p_name FROM part WHERE p_brand = 'Brand#1'""",
)
def q68(spark, sf):
    p = table(spark, sf, "part")
    return counts.value_difference(p, "p_name", p.filter("p_brand = 'Brand#1'"))


@register(
    "q210_l1_normalise",
    """SELECT p_partkey, round(p_size::DOUBLE / sum(p_size) OVER (PARTITION BY p_brand), 12) AS w FROM part""",
)
def q210(spark, sf):
    shares = counts.l1_normalise(table(spark, sf, "part"), "p_size", ["p_brand"])
    return shares.select("p_partkey", F.round("share", 12).alias("w"))
