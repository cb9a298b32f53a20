"""Log score of every row under a model, the least probable rows, and the column to blame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cpdspark.functions import distributions as dist
from cpdspark.functions.lineage import BROADCAST_ROWS, VECTOR_ROWS, sized
from cpdspark.operators import cpd, cpd_embedding, relaxed
from cpdspark.operators.bands import grid
from cpdspark.operators.cpd import POS, lookup_keys, with_position
from cpdspark.plans.spec import EMBEDDED, Kind, ModelSpec, Node, ROOTS


SHARED_NODES = 3  # so many counted nodes are worth a common reduction of the table


def lp(attr: str) -> str:
    return f"lp_{attr}"


def score(
    obs: DataFrame,
    spec: ModelSpec,
    id_col: str,
    emb: DataFrame | None = None,
    rows: DataFrame | None = None,
    rename: dict[str, str] | None = None,
    keep: list[str] = (),
    only: list[str] | None = None,
    point_mass: bool = False,
) -> DataFrame:
    """Score ``rows`` (default: the observed table itself) with distributions taken from ``obs``.

    Gives the id, the model's attributes, ``keep`` columns, one ``lp_<attr>`` per node, ``score``
    (their sum) and ``skipped``. Rows with a null in a modelled attribute are not used as
    observations, and get a null score. ``rename`` maps columns of ``rows`` to model attributes.
    ``only`` restricts the nodes that are scored.

    A deviation of 0 gives NaN. With ``point_mass`` it is a point instead: any other value has
    probability 0, and the value itself the density that the whole table's deviation gives at the mean.
    """
    if emb is None and any(n.kind in EMBEDDED for n in spec.nodes):
        raise ValueError("the model has embedded nodes, but no vectors were given")
    nodes = [n for n in spec.nodes if only is None or n.attr in only]
    if emb is not None and any(n.kind in EMBEDDED for n in nodes):
        emb = sized(emb, VECTOR_ROWS)
    observed = obs.select(id_col, *spec.attrs).dropna(subset=list(spec.attrs))
    source = obs if rows is None else rows
    for old, new in (rename or {}).items():
        source = source.withColumnRenamed(old, new)
    source = source.select(id_col, *spec.attrs, *[c for c in keep if c not in spec.attrs and c != id_col])
    asking = None if rows is None else source.dropna(subset=list(spec.attrs))
    counted = [n for n in nodes if _counts_only(n)]
    attrs = sorted({a for n in counted for a in (n.attr, *[p.attr for p in n.parents])})
    shared = [attrs] if len(counted) >= SHARED_NODES else []
    own = [n for n in nodes if asking is None and n.kind in (Kind.CAT, Kind.NUM)]
    n_rows, sizes = cpd.sketch(observed, [*shared, *[_tuple(n) for n in own]])
    tuples = cpd.reduced(observed, attrs, sizes.pop(0), n_rows) if shared else None
    base = {n.attr: tuples if tuples is not None and n in counted else observed for n in nodes}
    large = [n for n, size in zip(own, sizes) if size > BROADCAST_ROWS]
    scored = _attach_large(source, base, large, id_col, point_mass)
    for node in nodes:
        if node not in large:
            scored = attach(scored, base[node.attr], node, id_col, emb, asking, point_mass)
    present = _all_present(spec.attrs)
    lps = [F.when(present, F.col(lp(n.attr))).alias(lp(n.attr)) for n in nodes]
    total = sum((F.col(lp(n.attr)) for n in nodes[1:]), F.col(lp(nodes[0].attr)))
    return scored.select(*source.columns, *lps).select("*", total.alias("score"), (~present).alias("skipped"))


def _counts_only(node: Node) -> bool:
    """Nodes that need nothing but the counts of category tuples."""
    plain = node.kind is Kind.CAT and node.strict and not node.band
    return plain or node.kind in (Kind.UNIFORM, Kind.FREQ)


def _all_present(attrs) -> Column:
    ok = F.lit(True)
    for a in attrs:
        ok = ok & F.col(a).isNotNull()
    return ok


def attach(
    rows: DataFrame,
    obs: DataFrame,
    node: Node,
    id_col: str,
    emb: DataFrame | None = None,
    asking: DataFrame | None = None,
    point_mass: bool = False,
) -> DataFrame:
    """Add one node's ``lp_<attr>`` to the rows by a lookup on the node's distinct tuples.

    ``asking`` holds the rows whose tuples are asked for; without it ``rows`` are the observed
    rows themselves.
    """
    name = lp(node.attr)
    if node.kind in ROOTS:
        return _attach_root(rows, obs, node, asking is None)
    keys = lookup_keys(node) + ([] if node.numeric else [node.attr])
    asked = None if asking is None else with_position(asking, node).select(*keys).distinct()
    found = with_position(rows, node).join(sized(_lookup(obs, node, asked, emb, id_col)), keys, "left").drop(POS)
    return _with_density(found, obs, node, point_mass) if node.numeric else found


def _lookup(obs: DataFrame, node: Node, asked: DataFrame | None, emb: DataFrame | None, id_col: str) -> DataFrame:
    """What rows look up: the log probability of their tuple, or the moments of a number."""
    found = _estimate(obs, node, asked, emb, id_col)
    if node.numeric:
        return found.select(
            *lookup_keys(node), F.col("mean").alias(f"_mean_{node.attr}"), F.col("std").alias(f"_std_{node.attr}")
        )
    return found.select(*lookup_keys(node), node.attr, F.col("lp").alias(lp(node.attr)))


def _with_density(found: DataFrame, obs: DataFrame, node: Node, point_mass: bool) -> DataFrame:
    x, mean, std = F.col(node.attr).cast("double"), F.col(f"_mean_{node.attr}"), F.col(f"_std_{node.attr}")
    density = cpd.numeric_density(node, x, mean, std)
    if point_mass:
        found = found.withColumn("_g", cpd.global_moments(obs, node.attr))
        at_mean = cpd.numeric_density(node, mean, mean, F.col("_g.s"))
        point = F.when(x == mean, at_mean).otherwise(dist.neg_inf())
        density = F.when(std == 0, point).otherwise(density)
    return found.withColumn(lp(node.attr), density).drop(f"_mean_{node.attr}", f"_std_{node.attr}", "_g")


def _tuple(node: Node) -> list[Column]:
    """The columns of ``obs`` by which a node's lookup table has a row each."""
    place = [grid(F.col(node.band.attr)).alias(POS)] if node.band else []
    return [*[F.col(k) for k in lookup_keys(node) if k != POS], *place, *([] if node.numeric else [F.col(node.attr)])]


def _attach_large(
    rows: DataFrame, base: dict[str, DataFrame], nodes: list[Node], id_col: str, point_mass: bool
) -> DataFrame:
    """Add the ``lp_<attr>`` of nodes whose lookup tables are above the broadcast limit to the observed rows.

    A table whose keys are among another's is joined to that one, which has every observed tuple, so that
    the rows are shuffled once for both. Each table is read once, and so is not checkpointed.
    """
    places = {n.band.attr: f"{POS}_{n.band.attr}" for n in nodes if n.band}
    tables: list[tuple[list[str], DataFrame]] = []
    for node in nodes:
        place = places[node.band.attr] if node.band else POS
        keys = [place if k == POS else k for k in lookup_keys(node)] + ([] if node.numeric else [node.attr])
        tables.append((keys, _lookup(base[node.attr], node, None, None, id_col).withColumnRenamed(POS, place)))
    wide: list[tuple[list[str], DataFrame]] = []
    for keys, table in sorted(tables, key=lambda t: -len(t[0])):
        host = next((i for i, (wider, _) in enumerate(wide) if set(keys) <= set(wider)), None)
        if host is None:
            wide.append((keys, table))
        else:
            wider, finer = wide[host]
            wide[host] = wider, finer.join(table, [k for k in wider if k in keys], "left")
    for attr, place in places.items():
        rows = rows.withColumn(place, grid(F.col(attr)))
    for keys, table in wide:
        rows = rows.join(table, keys, "left")
    for node in nodes:
        rows = _with_density(rows, base[node.attr], node, point_mass) if node.numeric else rows
    return rows.drop(*places.values())


def _estimate(obs: DataFrame, node: Node, asked: DataFrame | None, emb: DataFrame | None, id_col: str) -> DataFrame:
    if node.kind is Kind.EMB_CAT:
        return cpd_embedding.categorical(obs, node, emb, id_col, asked)
    if node.kind is Kind.EMB_NUM:
        return cpd_embedding.numerical(obs, node, emb, id_col, asked)
    if asked is not None and not node.strict:
        module = relaxed
        return module.numerical(obs, node, asked) if node.numeric else module.categorical(obs, node, asked)
    return cpd.numerical(obs, node, asked) if node.numeric else cpd.categorical(obs, node, asked)


def _attach_root(rows: DataFrame, obs: DataFrame, node: Node, self_scoring: bool) -> DataFrame:
    name, x = lp(node.attr), F.col(node.attr)
    if node.kind is Kind.UNIFORM_CONT:
        span = obs.agg(F.struct(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi"))).scalar()
        spanned = rows.withColumn("_span", span)
        density = dist.uniform_continuous(x.cast("double"), F.col("_span.lo"), F.col("_span.hi"))
        return spanned.withColumn(name, density).drop("_span")
    if node.kind is Kind.BERNOULLI:
        rate = obs.agg(F.avg(x.cast("double"))).scalar()
        return rows.withColumn(name, dist.bernoulli(x.cast("double") > 0, rate))
    root = cpd.roots(obs, node, self_scoring)
    if isinstance(root, Column):
        return rows.withColumn(name, root)
    joined = rows.join(sized(root.select(node.attr, F.col("lp").alias(name))), node.attr, "left")
    return joined.withColumn(name, F.coalesce(name, dist.neg_inf()))


def most_improbable(scored: DataFrame, k: int, id_col: str) -> DataFrame:
    """The k rows of least score; ties by id. Rows without a score are never suspects."""
    return scored.filter(~F.col("skipped")).orderBy("score", id_col).limit(k)


def explain(scored: DataFrame, spec: ModelSpec) -> DataFrame:
    """Add ``worst_attr``, ``worst_lp`` and all attributes from least to most probable."""
    parts = F.array(*[F.struct(F.col(lp(a)).alias("lp"), F.lit(a).alias("attr")) for a in spec.attrs])
    return (
        scored.withColumn("blame", F.array_sort(parts))
        .withColumn("worst_attr", F.col("blame")[0]["attr"])
        .withColumn("worst_lp", F.col("blame")[0]["lp"])
    )


def score_row(obs: DataFrame, spec: ModelSpec, id_col: str, row: dict, emb: DataFrame | None = None) -> DataFrame:
    """Score one row given as a dict of the model's attributes."""
    schema = obs.select(id_col, *spec.attrs).schema
    one = obs.sparkSession.createDataFrame([tuple(row.get(f.name) for f in schema)], schema)
    return score(obs, spec, id_col, emb, rows=one)
