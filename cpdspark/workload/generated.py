"""Queries on injected errors, repairs, synthetic rows, and learnt embeddings."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from cpdspark.functions.text import EDIT_ERROR_BASE, EDIT_ERROR_TERMS
from cpdspark.operators import fuzzy, inject, metrics, repair, synth, typos
from cpdspark.operators.score import most_improbable, score
from cpdspark.operators.vocabulary import (
    embeddings_by_context,
    learn_embeddings,
    pair_features,
    plausibility,
    plausibility_model,
)
from cpdspark.plans.prices import RENT_PRICES
from cpdspark.plans.spec import ModelSpec, band, cat, num, uniform, freq
from cpdspark.workload.common import (
    part_embeddings,
    rounded,
    sql_distances,
    sql_embeddings,
    sql_index,
    sql_normal,
    sql_smoothed,
    sql_unit,
    table,
)
from cpdspark.workload.models import PART_SPEC, SOFT, _PART_SCORE

QUERIES = {}
ORACLES = {}


def register(name: str, sql: str | None = None):
    def keep(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return keep


# Injection -----------------------------------------------------------------------------------

_COLS = ["p_partkey", "p_brand", "p_type", "p_name", "p_size", "p_retailprice"]
_ATTRS = ["p_type", "p_name", "p_size", "p_retailprice"]
_TYPES = {"p_size": "INTEGER", "p_retailprice": "DOUBLE"}


def _sql_values(pivot: str, attrs: list[str], part: str = "part") -> str:
    """CTEs with everything that can be drawn: never, seen and per-row values by number."""
    long = " UNION ALL ".join(f"SELECT {pivot} AS key, '{a}' AS attr, CAST({a} AS VARCHAR) AS value FROM {part}" for a in attrs)
    num_ = "row_number() OVER (PARTITION BY attr, key ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY attr, key) AS sz"
    return f"""long AS ({long}), pairs AS (SELECT DISTINCT attr, key, value FROM long),
    dom AS (SELECT DISTINCT attr, value FROM long), keys AS (SELECT DISTINCT key FROM long),
    never AS (SELECT attr, key, value, {num_} FROM (SELECT d.attr, k.key, d.value FROM dom d, keys k WHERE NOT EXISTS
      (SELECT 1 FROM pairs p WHERE p.attr = d.attr AND p.key = k.key AND p.value = d.value))),
    seen AS (SELECT attr, key, value, {num_} FROM pairs), byrow AS (SELECT attr, key, value, {num_} FROM long)"""


def _sql_injected(
    seed: int,
    p: float,
    force: str,
    attrs: list[str] = _ATTRS,
    share: float = 0.05,
    columns: list[str] = _COLS,
    size: int | None = None,
    shift: dict[str, float] = {},
) -> str:
    free = [f"EXISTS (SELECT 1 FROM never v WHERE v.key = c.p_brand AND v.attr = '{a}')" for a in attrs]
    flips = [f"(f{i} AND {sql_unit(seed, chr(39) + 'flip' + chr(39), chr(39) + a + chr(39), 'draw')} < {p})" for i, a in enumerate(attrs)]
    any_free = " OR ".join(f"f{i}" for i in range(len(attrs)))
    none = "NOT (" + " OR ".join(flips) + ")"
    n_free = "(" + " + ".join(f"f{i}::INTEGER" for i in range(len(attrs))) + ")"
    forced = sql_index(sql_unit(seed, "'forced'", "draw"), n_free) if force == "random" else f"{n_free} - 1"
    before = [" + ".join(["0", *(f"f{k}::INTEGER" for k in range(i))]) for i in range(len(attrs))]
    cells = " UNION ALL ".join(
        f"SELECT draw, p_brand AS key, '{a}' AS attr FROM copies WHERE {flips[i]} OR ({none} AND f{i} AND {forced} = {before[i]})"
        for i, a in enumerate(attrs)
    )
    pick = sql_index(sql_unit(seed, "'value'", "c.attr", "c.draw"), "n.sz")
    new = ", ".join(f"max(value) FILTER (attr = '{a}') AS new_{a}" for a in attrs)
    kind = lambda a: _TYPES.get(a, "VARCHAR")
    plus = lambda a: f" + {shift[a]}::DOUBLE" if a in shift else ""
    fresh = lambda a: f"coalesce(CAST(new_{a} AS {kind(a)}){plus(a)}, {a})" if a in attrs else a
    cols = ", ".join(f"{fresh(a)} AS {a}" for a in columns[2:])
    own = "SELECT * FROM part" if size is None else f"SELECT * FROM part ORDER BY {sql_unit(seed, chr(39) + 'size' + chr(39), 'p_partkey')}, p_partkey LIMIT {size}"
    return f"""WITH own AS ({own}), {_sql_values('p_brand', attrs, 'own')},
    base AS (SELECT c.*, {", ".join(f"{x} AS f{i}" for i, x in enumerate(free))} FROM own c),
    ranked AS (SELECT *, row_number() OVER (ORDER BY p_partkey) - 1 AS rank, count(*) OVER () AS total FROM base
      WHERE {any_free} OR NOT EXISTS (SELECT 1 FROM base WHERE {any_free})),
    copies AS (SELECT t.draw, r.* FROM range(CAST((SELECT ceil({share}::DOUBLE * count(*)) FROM own) AS BIGINT)) t(draw) JOIN ranked r
      ON r.rank = {sql_index(sql_unit(seed, "'row'", 't.draw'), 'r.total')}),
    cells AS ({cells}),
    drawn AS (SELECT c.draw, c.attr, n.value FROM cells c JOIN never n ON n.attr = c.attr AND n.key = c.key AND n.i = {pick}),
    wide AS (SELECT draw, {new} FROM drawn GROUP BY draw)
    SELECT {", ".join(columns)}, 0 AS negative_sample FROM own
    UNION ALL SELECT -draw - 1, p_brand, {cols}, ({any_free})::INTEGER FROM copies LEFT JOIN wide USING (draw)"""


@register("q69_inject", _sql_injected(7, 0.2, "random"))
def q69(spark, sf):
    p = table(spark, sf, "part").select(*_COLS)
    return inject.inject_errors(p, "p_partkey", "p_brand", _ATTRS, 0.2, 7, share=0.05)


@register("q70_inject_last", _sql_injected(8, 0.2, "last"))
def q70(spark, sf):
    p = table(spark, sf, "part").select(*_COLS)
    return inject.inject_errors(p, "p_partkey", "p_brand", _ATTRS, 0.2, 8, share=0.05, force="last")


_SATURATED = ["p_type", "p_size"]


@register("q69_inject_saturated", _sql_injected(7, 0.2, "random", _SATURATED))
def q69b(spark, sf):
    """Attributes of which, in a large table, every value occurs with every brand: copies stay unharmed."""
    p = table(spark, sf, "part").select(*_COLS)
    return inject.inject_errors(p, "p_partkey", "p_brand", _SATURATED, 0.2, 7, share=0.05)


def _sql_per_pivot(seed: int, n: int, modes: dict[str, str], label: str) -> str:
    """Bad rows per brand; ``modes`` gives per attribute an SQL expression never/seen/row."""
    cells = " UNION ALL ".join(
        f"SELECT key, draw, '{a}' AS attr, {mode} AS mode, {sql_unit(seed, chr(39) + 'value' + chr(39), chr(39) + a + chr(39), 'key', 'draw')} AS u FROM grid"
        for a, mode in modes.items()
    )
    pick = "CAST(least(floor(c.u * {t}.sz), {t}.sz - 1) AS BIGINT)"
    wide = ", ".join(
        f"CAST(max(value) FILTER (attr = '{a}') AS {'INTEGER' if a == 'p_size' else 'VARCHAR'}) AS {a}" for a in modes
    )
    return f"""WITH {_sql_values('p_brand', list(modes))}, grid AS (SELECT key, draw FROM keys, range({n}) t(draw)), cells AS ({cells}),
    drawn AS (SELECT c.key, c.draw, c.attr, CASE c.mode WHEN 'never' THEN coalesce(v.value, s.value) WHEN 'seen' THEN s.value ELSE b.value END AS value
      FROM cells c LEFT JOIN never v ON v.attr = c.attr AND v.key = c.key AND v.i = {pick.format(t='v')}
      LEFT JOIN seen s ON s.attr = c.attr AND s.key = c.key AND s.i = {pick.format(t='s')}
      LEFT JOIN byrow b ON b.attr = c.attr AND b.key = c.key AND b.i = {pick.format(t='b')})
    SELECT key AS p_brand, CAST(draw AS INTEGER) AS draw, {wide}, {label} FROM drawn GROUP BY key, draw"""


def _also(seed: int, a: str, i: int, m: int, q: float) -> str:
    bad = sql_index(sql_unit(seed, "'bad'", "key", "draw"), str(m))
    also = sql_unit(seed, "'also'", f"'{a}'", "key", "draw")
    return f"CASE WHEN {bad} = {i} OR {also} < {q} THEN 'never' ELSE 'seen' END"


@register(
    "q71_inject_per_pivot",
    _sql_per_pivot(
        9, 4, {"p_type": _also(9, "p_type", 0, 2, 0.1), "p_name": _also(9, "p_name", 1, 2, 0.1), "p_size": "'seen'"},
        "1 AS negative_sample",
    ),
)
def q71(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_type", "p_name", "p_size")
    return inject.errors_per_pivot(p, "p_brand", ["p_size"], 4, 9)


@register(
    "q72_negatives",
    _sql_per_pivot(10, 4, {"p_type": "'never'", "p_name": "'never'", "p_size": "'row'"}, "0 AS good"),
)
def q72(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_type", "p_name", "p_size")
    return inject.training_negatives(p, "p_brand", ["p_size"], 4, 10)


_NEGATIVES = _sql_per_pivot(10, 4, {"p_type": "'never'", "p_name": "'never'", "p_size": "'row'"}, "0 AS good")


@register(
    "q67_training_set",
    f"""SELECT p_brand, p_type, p_name, p_size, 1 AS good FROM part
    UNION ALL SELECT p_brand, p_type, p_name, p_size, good FROM ({_NEGATIVES})""",
)
def q67(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_type", "p_name", "p_size")
    return inject.training_set(p, "p_brand", ["p_size"], 4, 10)


def _sql_typos(seed: int, prob: float | None = None) -> str:
    total = sum(EDIT_ERROR_BASE**i for i in range(EDIT_ERROR_TERMS))
    acc, steps = 0.0, []
    for i in range(12):
        acc += EDIT_ERROR_BASE**i / total
        steps.append(f"(CASE WHEN u >= {acc!r}::DOUBLE THEN 1 ELSE 0 END)")
    count = " + ".join(steps)
    if prob is not None:
        count = "0"
        for i in reversed(range(12)):
            more = sql_unit(seed, f"'more{i}'", "p_partkey")
            count = f"(CASE WHEN {more} < {prob / 2**i!r}::DOUBLE THEN 1 + {count} ELSE 0 END)"
    draw = lambda tag: sql_unit(seed, f"'{tag}'", "i + 1", "id")
    action = sql_index(draw("action"), "3")
    at = f"CASE WHEN a = 0 THEN {sql_index(draw('pos'), '(length(word) + 1)')} ELSE {sql_index(draw('pos'), 'length(word)')} END"
    return f"""WITH RECURSIVE n AS (SELECT p_partkey AS id, p_name AS word, {count} AS cnt
      FROM (SELECT *, {sql_unit(seed, "'typos'", 'p_partkey')} AS u FROM part)),
    t AS (SELECT id, word, 0 AS i, cnt FROM n UNION ALL
      SELECT id, CASE WHEN a = 0 THEN substr(word, 1, ps) || ch || substr(word, ps + 1)
        WHEN length(word) = 0 THEN word WHEN a = 1 THEN substr(word, 1, ps) || substr(word, ps + 2)
        ELSE replace(word, substr(word, ps + 1, 1), ch) END, i + 1, cnt
      FROM (SELECT *, {at} AS ps FROM (SELECT *, {action} AS a, chr(CAST(97 + {sql_index(draw('letter'), '26')} AS INTEGER)) AS ch FROM t WHERE i < cnt)))
    SELECT id AS p_partkey, word AS dirty, CAST(cnt AS INTEGER) AS n_typos FROM t WHERE i = cnt"""


@register("q73_typos", _sql_typos(12))
def q73(spark, sf):
    out = typos.inject_typos(table(spark, sf, "part"), "p_partkey", "p_name", 12)
    return out.select("p_partkey", "dirty", "n_typos")


@register("q73_typos_halving", _sql_typos(13, 0.5))
def q73_halving(spark, sf):
    out = typos.inject_typos(table(spark, sf, "part"), "p_partkey", "p_name", 13, prob=0.5)
    return out.select("p_partkey", "dirty", "n_typos")


_GRID = [(size, k, p) for size in (None, 500, 1500) for k in (0.01, 0.05) for p in (0.2, 1.0)]


def _scenario(size, k, p):
    return f"k={k},p={p}" if size is None else f"s={size},k={k},p={p}"


@register(
    "q76_scenarios",
    " UNION ALL ".join(
        f"SELECT *, '{_scenario(size, k, p)}' AS scenario FROM ({_sql_injected(14, p, 'random', ['p_name', 'p_size'], k, size=size)})"
        for size, k, p in _GRID
    ),
)
def q76(spark, sf):
    p = table(spark, sf, "part").select(*_COLS)
    grid = [inject.Setting(_scenario(size, k, share), share, share=k, size=size) for size, k, share in _GRID]
    return inject.inject_grid(p, "p_partkey", "p_brand", ["p_name", "p_size"], grid, 14)


_E2E = ModelSpec((uniform("p_brand"), cat("p_type", "p_brand"), cat("p_size", "p_brand"), num("p_retailprice", "p_type")))


_E2E_COLS = ["p_partkey", "p_brand", "p_type", "p_size", "p_retailprice"]
_E2E_ATTRS, _E2E_SHIFT = ["p_type", "p_size", "p_retailprice"], {"p_retailprice": 500.0}


@register(
    "q34_injected_precision",
    f"""WITH t AS MATERIALIZED ({_sql_injected(15, 0.5, "random", _E2E_ATTRS, columns=_E2E_COLS, shift=_E2E_SHIFT)}),
    c AS (SELECT *, count(*) OVER (PARTITION BY p_brand) AS nb, count(*) OVER (PARTITION BY p_brand, p_type) AS nt,
      count(*) OVER (PARTITION BY p_brand, p_size) AS ns, count(*) OVER (PARTITION BY p_type) AS k,
      avg(p_retailprice) OVER (PARTITION BY p_type) AS m, stddev_samp(p_retailprice) OVER (PARTITION BY p_type) AS s FROM t),
    u AS (SELECT p_brand, count(DISTINCT p_type) AS ut, count(DISTINCT p_size) AS us FROM t GROUP BY 1),
    d AS (SELECT count(DISTINCT p_brand) AS db, count(DISTINCT p_type) AS dt, count(DISTINCT p_size) AS ds,
      avg(p_retailprice) AS gm, stddev_samp(p_retailprice) AS gs FROM t),
    sc AS (SELECT p_partkey, negative_sample, -ln(db) + {sql_smoothed('nt', 'nb', 'ut', 'dt')} + {sql_smoothed('ns', 'nb', 'us', 'ds')} +
      {sql_normal('p_retailprice', 'CASE WHEN k <= 1 THEN gm ELSE m END', 'CASE WHEN k <= 1 THEN gs ELSE s END')} AS score
      FROM c JOIN u USING (p_brand), d),
    n AS (SELECT sum(negative_sample) AS k FROM t),
    top AS (SELECT negative_sample FROM sc ORDER BY round(score, 9), p_partkey LIMIT (SELECT k FROM n))
    SELECT (SELECT k FROM n)::BIGINT AS k, round(avg(negative_sample), 9) AS precision, round(sum(negative_sample) / (SELECT k FROM n), 9) AS recall FROM top""",
)
def q34_injected(spark, sf):
    p = table(spark, sf, "part").select(*_E2E_COLS)
    bad = inject.inject_errors(p, "p_partkey", "p_brand", _E2E_ATTRS, 0.5, 15, share=0.05, shift=_E2E_SHIFT)
    scored = rounded(score(bad, _E2E, "p_partkey", keep=["negative_sample"]), 9)
    return rounded(metrics.precision_at_k(scored, "negative_sample", "p_partkey"), 9)


# Repair --------------------------------------------------------------------------------------


@register(
    "q77_proposal",
    f"""WITH {sql_embeddings(SOFT)}, {sql_distances(SOFT)},
    a AS (SELECT 'p_brand' AS attr, a AS value, b AS candidate, d FROM dist_p_brand UNION ALL SELECT 'p_type', a, b, d FROM dist_p_type),
    r AS (SELECT *, row_number() OVER (PARTITION BY attr, value, value = candidate ORDER BY d, candidate) AS rk FROM a),
    w AS (SELECT *, CASE WHEN value <> candidate AND rk <= 3 THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM r),
    pr AS (SELECT attr, value, CASE WHEN weight > 1 THEN candidate END AS candidate, weight, weight / sum(weight) OVER (PARTITION BY attr, value) AS p FROM w)
    SELECT attr, value, candidate, count(*)::BIGINT AS n, weight, round(avg(p), 9) AS prob FROM pr GROUP BY attr, value, candidate, weight""",
)
def q77(spark, sf):
    return rounded(repair.proposal(part_embeddings(spark, sf, SOFT), 3), 9)


def _suspects(spark, sf, n: int):
    return most_improbable(score(table(spark, sf, "part"), PART_SPEC, "p_partkey"), n, "p_partkey")


_REPAIR_SQL = f"""WITH {_PART_SCORE}, top AS (SELECT * FROM sc ORDER BY lp_p_brand + lp_p_type + lp_p_retailprice, p_partkey LIMIT 20),
    types AS (SELECT DISTINCT p_type FROM part),
    st AS (SELECT p_brand, p_type, count(*) AS n, avg(p_retailprice) AS m2, stddev_samp(p_retailprice) AS s2 FROM part GROUP BY 1, 2),
    tot AS (SELECT p_brand, count(*) AS nb2 FROM part GROUP BY 1),
    cand AS (SELECT top.p_partkey, top.p_type AS present, t.p_type,
      {sql_smoothed('coalesce(n, 0)', 'nb2', 'seen.seen', 'dt')} +
      {sql_normal('top.p_retailprice', 'CASE WHEN coalesce(n, 0) <= 1 THEN gm ELSE m2 END', 'CASE WHEN coalesce(n, 0) <= 1 THEN gs ELSE s2 END')} AS lj
      FROM top CROSS JOIN types t JOIN tot ON tot.p_brand = top.p_brand JOIN seen ON seen.p_brand = top.p_brand
      LEFT JOIN st ON st.p_brand = top.p_brand AND st.p_type = t.p_type, d),
    w AS (SELECT *, exp(lj - max(lj) OVER (PARTITION BY p_partkey)) AS w FROM cand)
    SELECT p_partkey, present, p_type, round(lj, 6) AS log_joint, round(w / sum(w) OVER (PARTITION BY p_partkey), 6) AS posterior,
      row_number() OVER (PARTITION BY p_partkey ORDER BY lj DESC, p_type)::INTEGER AS rank FROM w QUALIFY rank <= 3"""


@register("q79_repair_exact", _REPAIR_SQL)
def q79(spark, sf):
    out = repair.repair_exact(_suspects(spark, sf, 20), table(spark, sf, "part"), PART_SPEC, "p_partkey", "p_type", 3)
    return rounded(out)


# The same model with names, of which most are not seen with a brand at that price.
_NAME_SPEC = ModelSpec((uniform("p_brand"), cat("p_name", "p_brand"), num("p_retailprice", "p_brand", "p_name")))


def _name_suspects(spark, sf, n: int):
    return most_improbable(score(table(spark, sf, "part"), _NAME_SPEC, "p_partkey"), n, "p_partkey")


@register("q79_repair_classes", _REPAIR_SQL.replace("p_type", "p_name"))
def q79b(spark, sf):
    out = repair.repair_exact(_name_suspects(spark, sf, 20), table(spark, sf, "part"), _NAME_SPEC, "p_partkey", "p_name", 3)
    return rounded(out)


@register(
    "q25_candidate_classes",
    f"""WITH {_PART_SCORE.replace('p_type', 'p_name')},
    top AS (SELECT * FROM sc ORDER BY lp_p_brand + lp_p_name + lp_p_retailprice, p_partkey LIMIT 20),
    sup AS (SELECT DISTINCT top.p_partkey, part.p_name AS v FROM top JOIN part ON part.p_brand = top.p_brand),
    mis AS (SELECT t.p_partkey, e.v, row_number() OVER (PARTITION BY t.p_partkey ORDER BY e.v) - 1 AS i, count(*) OVER (PARTITION BY t.p_partkey) AS m
      FROM top t, (SELECT DISTINCT p_name AS v FROM part) e WHERE NOT EXISTS (SELECT 1 FROM sup WHERE sup.p_partkey = t.p_partkey AND sup.v = e.v))
    SELECT p_partkey, top.p_name AS present, v AS p_name, 1::BIGINT AS times FROM top JOIN sup USING (p_partkey)
    UNION ALL SELECT p_partkey, top.p_name, v, CASE WHEN i = 0 THEN m ELSE 0 END::BIGINT FROM top JOIN mis USING (p_partkey) WHERE i < 3""",
)
def q25b(spark, sf):
    suspects = _name_suspects(spark, sf, 20).select("p_partkey", *_NAME_SPEC.attrs)
    out = repair.candidate_classes(suspects, table(spark, sf, "part"), _NAME_SPEC, "p_partkey", "p_name", 3)
    return out.select("p_partkey", "present", "p_name", "times")


@register("q78_repair_sampled")
def q78(spark, sf):
    emb = part_embeddings(spark, sf, ["p_type"])
    p = table(spark, sf, "part")
    out = repair.repair_sampled(_suspects(spark, sf, 20), p, PART_SPEC, "p_partkey", "p_type", emb, 2, 50, 16)
    return rounded(out)


@register("q80_impute")
def q80(spark, sf):
    p = table(spark, sf, "part")
    out = synth.impute(_suspects(spark, sf, 20), p, PART_SPEC, "p_partkey", ["p_type"], 50, 17)
    return rounded(out)


@register(
    "q80_evidence",
    f"""WITH {_PART_SCORE}, top AS (SELECT * FROM sc ORDER BY lp_p_brand + lp_p_type + lp_p_retailprice, p_partkey LIMIT 20),
    st AS (SELECT p_brand, p_type, count(*) AS n, avg(p_retailprice) AS m2, stddev_samp(p_retailprice) AS s2 FROM part GROUP BY 1, 2),
    tot AS (SELECT p_brand, count(*) AS nb2 FROM part GROUP BY 1), types AS (SELECT DISTINCT p_type FROM part),
    cand AS (SELECT top.p_partkey, -ln(db) + {sql_smoothed('coalesce(n, 0)', 'nb2', 'seen.seen', 'dt')} +
      {sql_normal('top.p_retailprice', 'CASE WHEN coalesce(n, 0) <= 1 THEN gm ELSE m2 END', 'CASE WHEN coalesce(n, 0) <= 1 THEN gs ELSE s2 END')} AS lj
      FROM top CROSS JOIN tot CROSS JOIN types t JOIN seen ON seen.p_brand = tot.p_brand
      LEFT JOIN st ON st.p_brand = tot.p_brand AND st.p_type = t.p_type, d),
    w AS (SELECT *, max(lj) OVER (PARTITION BY p_partkey) AS best FROM cand)
    SELECT p_partkey, round(max(best) + ln(sum(exp(lj - best))), 6) AS log_evidence FROM w GROUP BY p_partkey""",
)
def q80b(spark, sf):
    """Brand and type missing: both are summed out, whatever they were."""
    return rounded(synth.evidence(_suspects(spark, sf, 20), table(spark, sf, "part"), PART_SPEC, "p_partkey", ["p_type", "p_brand"]))


@register(
    "q25_candidates",
    f"""WITH {_PART_SCORE}, top AS (SELECT * FROM sc ORDER BY lp_p_brand + lp_p_type + lp_p_retailprice, p_partkey LIMIT 20)
    SELECT p_partkey, top.p_type AS present, t.p_type FROM top, (SELECT DISTINCT p_type FROM part) t""",
)
def q25(spark, sf):
    p = table(spark, sf, "part")
    suspects = _suspects(spark, sf, 20).select("p_partkey", "p_type")
    return repair.candidates(suspects, p, "p_partkey", "p_type")


_DICTIONARY = """obs AS (SELECT DISTINCT p_brand, p_name FROM part), dict AS (SELECT DISTINCT p_brand, p_name AS entry FROM part),
    raw AS (SELECT p_brand, p_name, entry, p_name AS x, entry AS y, array_to_string(list_sort(string_split(p_name, ' ')), ' ') AS sx,
      array_to_string(list_sort(string_split(entry, ' ')), ' ') AS sy FROM obs JOIN dict USING (p_brand)),
    sc AS (SELECT p_brand, p_name, entry, greatest(1 - levenshtein(x, y) / greatest(length(x), length(y))::DOUBLE,
      1 - levenshtein(sx, sy) / greatest(length(sx), length(sy))::DOUBLE) AS s FROM raw),
    w AS (SELECT *, CASE WHEN s > 0.5 THEN s * 5 ELSE s END AS weight FROM sc),
    pr AS (SELECT *, weight / sum(weight) OVER (PARTITION BY p_brand, p_name) AS prob FROM w)"""


def _dictionary_prior(spark, sf, near=None):
    p = table(spark, sf, "part")
    dictionary = p.select(F.col("p_name").alias("entry"), F.col("p_brand").alias("brand")).distinct()
    return rounded(fuzzy.dictionary_prior(p, "p_name", dictionary, "entry", ("p_brand", "brand"), near=near), 9)


@register(
    "q56_dictionary_prior",
    f"WITH {_DICTIONARY} SELECT p_brand, p_name, entry, round(weight, 9) AS weight, round(prob, 9) AS prob FROM pr",
)
def q56(spark, sf):
    return _dictionary_prior(spark, sf)


@register(
    "q56_dictionary_near",
    f"""WITH {_DICTIONARY}
    SELECT p_brand, p_name, entry, round(weight, 9) AS weight, round(prob, 9) AS prob, 1::BIGINT AS entries FROM pr WHERE s > 0.5
    UNION ALL SELECT p_brand, p_name, NULL, round(sum(weight), 9), round(sum(prob), 9), count(*)::BIGINT FROM pr WHERE s <= 0.5 GROUP BY 1, 2""",
)
def q56b(spark, sf):
    return _dictionary_prior(spark, sf, near=0.5)


# Synthetic rows ------------------------------------------------------------------------------


@register("q74_synthesise")
def q74(spark, sf):
    p = table(spark, sf, "part")
    spec = ModelSpec(
        (freq("p_brand"), cat("p_type", "p_brand"), num("p_size", "p_brand", greater_zero=True), num("p_retailprice", "p_type", band("p_size", 5)))
    )
    return rounded(synth.simulate(p, spec, p.count(), 18, "p_partkey"))


def _sql_value(a: str, seed: int) -> str:
    return sql_unit(seed, f"'value-{a}'", "id")


def _sql_from_rows(a: str, seed: int, drawn: str, parents: list[str], where: str, order: str) -> str:
    """CTEs ``<a>_m`` (rows that match a drawn row) and ``<a>_d`` (the drawn row with its value of ``a``)."""
    keep = ", ".join(parents)
    return f"""{a}_m AS (SELECT z.id, p.{a} AS v, row_number() OVER (PARTITION BY z.id ORDER BY {order}) - 1 AS i,
      count(*) OVER (PARTITION BY z.id) AS n FROM {drawn} z JOIN part p ON {where}),
    {a}_n AS (SELECT z.id, coalesce(max(n), 0) AS n, count(DISTINCT v) AS seen FROM {drawn} z LEFT JOIN {a}_m m ON m.id = z.id GROUP BY 1),
    {a}_dom AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS x, count(*) OVER () AS d FROM (SELECT DISTINCT {a} AS v FROM part)),
    {a}_none AS (SELECT z.id, q.v, row_number() OVER (PARTITION BY z.id ORDER BY q.v) - 1 AS i FROM {drawn} z, {a}_dom q
      WHERE NOT EXISTS (SELECT 1 FROM {a}_m m WHERE m.id = z.id AND m.v = q.v)),
    {a}_how AS (SELECT z.*, n, seen, d, CASE WHEN n = 0 THEN 'any' WHEN seen < d AND {sql_unit(seed, f"'unseen-{a}'", 'z.id')} >= {1 / 1.1!r}::DOUBLE THEN 'unseen'
      ELSE 'seen' END AS how, {sql_unit(seed, f"'value-{a}'", 'z.id')} AS u FROM {drawn} z JOIN {a}_n USING (id), (SELECT max(d) AS d FROM {a}_dom) e),
    {a}_d AS (SELECT h.id, {keep}, coalesce(m.v, o.v, q.v) AS {a} FROM {a}_how h
      LEFT JOIN {a}_m m ON how = 'seen' AND m.id = h.id AND m.i = {sql_index('h.u', 'h.n')}
      LEFT JOIN {a}_none o ON how = 'unseen' AND o.id = h.id AND o.i = {sql_index('h.u', '(h.d - h.seen)')}
      LEFT JOIN {a}_dom q ON how = 'any' AND q.x = {sql_index('h.u', 'h.d')})"""


_BANDED_SPEC = ModelSpec(
    (
        uniform("p_brand"),
        freq("p_size"),
        cat("p_type", "p_brand", band("p_size", 3)),
        cat("p_name", "p_type", "p_brand", band("p_size", 1), strict=False),
    )
)
_BANDED_ROWS = 400
_MET = {
    "t": "EXISTS (SELECT 1 FROM part p WHERE p.p_type = z.p_type)",
    "b": "EXISTS (SELECT 1 FROM part p WHERE p.p_type = z.p_type AND p.p_brand = z.p_brand)",
    "s": "EXISTS (SELECT 1 FROM part p WHERE p.p_type = z.p_type AND (NOT b OR p.p_brand = z.p_brand) AND abs(p.p_size - z.p_size) <= 1)",
}


@register(
    "q74_synthesise_banded",
    f"""WITH b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT p_brand FROM part)),
    s AS (SELECT p_size, row_number() OVER (ORDER BY p_size::VARCHAR) - 1 AS i, count(*) OVER () AS n FROM part),
    z0 AS (SELECT id, p_brand, p_size FROM (SELECT range AS id FROM range({_BANDED_ROWS})) g
      JOIN b ON b.i = {sql_index(_sql_value("p_brand", 21), 'b.n')} JOIN s ON s.i = {sql_index(_sql_value("p_size", 21), 's.n')}),
    {_sql_from_rows("p_type", 21, "z0", ["p_brand", "p_size"], "p.p_brand = z.p_brand AND abs(p.p_size - z.p_size) <= 3", "p.p_size, p.p_type")},
    z1 AS (SELECT z.*, {_MET['b']} AS b FROM p_type_d z), z2 AS (SELECT z.*, {_MET['s']} AS s FROM z1 z),
    {_sql_from_rows("p_name", 21, "z2", ["p_brand", "p_size", "p_type"],
      "p.p_type = z.p_type AND (NOT b OR p.p_brand = z.p_brand) AND (NOT s OR abs(p.p_size - z.p_size) <= 1)",
      "CASE WHEN s THEN p.p_size END, p.p_name")}
    SELECT id AS p_partkey, p_brand, p_size, p_type, p_name FROM p_name_d""",
)
def q74b(spark, sf):
    """Bands with unseen values, and a node that drops parents that nothing matches."""
    return synth.simulate(table(spark, sf, "part"), _BANDED_SPEC, _BANDED_ROWS, 21, "p_partkey")


_AREA = f"(20.0::DOUBLE + {sql_unit(19, chr(39) + 'space' + chr(39), 'fact')} * 180.0::DOUBLE)"


@register(
    "q75_facts_from_dimension",
    f"""WITH dim AS (SELECT s_suppkey, 6.0::DOUBLE + s_nationkey * 0.25::DOUBLE AS base, 50.0::DOUBLE AS seen_space,
      round(50 * (6.0::DOUBLE + s_nationkey * 0.25::DOUBLE), 2) AS seen_price, s_nationkey * 1000 AS lo, s_nationkey * 1000 + 99 AS hi,
      1900 + s_nationkey * 5 AS year, row_number() OVER (ORDER BY s_suppkey) - 1 AS rank, count(*) OVER () AS total FROM supplier),
    f AS (SELECT fact, d.*, {_AREA} AS area, lo + {sql_index(sql_unit(19, "'code'", 'fact'), '(hi - lo + 1)')} AS code
      FROM range(CAST((SELECT count(*) * 20 FROM supplier) AS BIGINT)) t(fact) JOIN dim d ON d.rank = {sql_index(sql_unit(19, "'dim'", 'fact'), 'd.total')}),
    p AS (SELECT *, base + 2.5 + CASE WHEN year < 1949 THEN 1.5 WHEN year < 1969 THEN -1.0 WHEN year > 1990 THEN (year - 1990) * 0.25::DOUBLE ELSE 0 END
      + (100.0::DOUBLE - area) * 0.0425::DOUBLE AS per_unit FROM f)
    SELECT fact, s_suppkey, code::BIGINT AS code, year, round(CASE WHEN area * per_unit < 150 THEN seen_space ELSE area END, 2) AS space,
      round(CASE WHEN area * per_unit < 150 THEN seen_price ELSE area * per_unit END, 2) AS price FROM p""",
)
def q75(spark, sf):
    s = table(spark, sf, "supplier").select(
        "s_suppkey",
        (F.lit(6.0) + F.col("s_nationkey") * 0.25).alias("base"),
        F.lit(50.0).alias("seen_space"),
        F.round((F.lit(6.0) + F.col("s_nationkey") * 0.25) * 50, 2).alias("seen_price"),
        (F.col("s_nationkey") * 1000).alias("lo"),
        (F.col("s_nationkey") * 1000 + 99).alias("hi"),
        (F.col("s_nationkey") * 5 + 1900).alias("year"),
    )
    rule = replace(RENT_PRICES, least=150.0)
    return synth.facts_from_dimension(
        s, "s_suppkey", "base", "lo", "hi", "year", s.count() * 20, 19, rule, observed=("seen_space", "seen_price")
    )


# Learning ------------------------------------------------------------------------------------


@register("q85_embeddings")
def q85(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_type", "p_name", "p_size")
    rows = inject.training_set(p, "p_brand", ["p_size"], 20, 20)
    emb, _ = learn_embeddings(rows, ["p_brand", "p_type", "p_name"], ["p_size"], "good", 8, 3, 21)
    return emb.select("attr", "value", F.size("vec").alias("dim"))


_CONTEXT = ["p_brand", "p_type", "p_name"]
_MET = " UNION ALL ".join(
    f"SELECT '{a}' AS attr, {a} AS value, '{c}' AS c_attr, {c} AS c_value FROM part" for a in _CONTEXT for c in _CONTEXT if a != c
)
_SIGN = f"CASE WHEN {sql_unit(22, chr(39) + 'sign' + chr(39) + ' || i', 'c_attr', 'c_value')} < 0.5 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END"


@register(
    "q85_embeddings_context",
    f"""WITH m AS ({_MET}), p AS (SELECT attr, value, c_attr, c_value, count(*) AS n FROM m GROUP BY ALL),
    o AS (SELECT attr, value, sum(n)::DOUBLE AS nw FROM p GROUP BY ALL), t AS (SELECT sum(n)::DOUBLE AS total FROM p),
    w AS (SELECT p.*, greatest(ln(n * total / (x.nw * y.nw)), 0) AS ppmi FROM p JOIN o x ON x.attr = p.attr AND x.value = p.value
      JOIN o y ON y.attr = c_attr AND y.value = c_value, t)
    SELECT attr, value, i::INTEGER AS i, round(sum(ppmi * {_SIGN}) / sqrt(8.0::DOUBLE), 6) AS x FROM w, range(8) r(i) GROUP BY ALL""",
)
def q85_context(spark, sf):
    emb = embeddings_by_context(table(spark, sf, "part"), _CONTEXT, 8, 22)
    return rounded(emb.select("attr", "value", F.posexplode("vec").alias("i", "x")))


@register("q86_plausibility")
def q86(spark, sf):
    p = table(spark, sf, "part").select("p_brand", "p_type", "p_name", "p_size")
    rows = inject.training_set(p, "p_brand", ["p_size"], 20, 23)
    emb = part_embeddings(spark, sf, ["p_brand", "p_type", "p_name"])
    features = pair_features(rows, emb, ["p_brand", "p_type", "p_name"], ["p_size"], keep=["good"])
    inputs = [c for c in features.columns if c != "good"]
    model = plausibility_model(features, inputs, "good", 10)
    return plausibility(model, features, inputs).select("good", F.round("plausibility", 4).alias("plausibility"))
