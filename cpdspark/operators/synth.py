"""New rows: from a fitted model, for missing cells, and from a dimension table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cpdspark.functions import distributions as dist
from cpdspark.functions.lineage import cut
from cpdspark.functions.rng import gumbel, pick_index, standard_normal, tagged
from cpdspark.operators import cpd, cpd_embedding, relaxed
from cpdspark.operators.bands import band_counts, band_distinct, grid_radius
from cpdspark.operators.cpd import POS, lookup_keys, with_position
from cpdspark.operators.cumulative import chunks_for, chunks_of, global_rank, running_totals, totals_at
from cpdspark.operators.draws import NEVER, ROW, SEEN, draw, seen_values
from cpdspark.operators.score import lp, score
from cpdspark.plans.prices import PriceRule
from cpdspark.plans.spec import EMBEDDED, Kind, ModelSpec, Node, Role

_SEEN_MASS = 1.0 / (1.0 + dist.UNSEEN_SHARE)


def simulate(
    obs: DataFrame, spec: ModelSpec, n: int, seed: int, id_col: str, emb: DataFrame | None = None
) -> DataFrame:
    """``n`` rows drawn from the model fitted to ``obs``: parents first, each column from its CPD.

    ``id_col`` identifies the observed rows; the new rows are numbered 0 .. n-1 in it.
    """
    rows = obs.sparkSession.range(n).select(F.col("id").alias(id_col))
    return sample_nodes(rows, obs, spec, [x.attr for x in spec.nodes], seed, id_col, emb).select(id_col, *spec.attrs)


def sample_nodes(
    rows: DataFrame,
    obs: DataFrame,
    spec: ModelSpec,
    attrs: list[str],
    seed: int,
    id_col: str,
    emb: DataFrame | None = None,
) -> DataFrame:
    """Add drawn columns to rows that have all other columns their parents need."""
    clean = obs.dropna(subset=list(spec.attrs))
    for node in spec.topological():
        if node.attr in attrs:
            rows = cut(_sample(rows, clean, node, seed, id_col, emb))
    return rows


def _sample(
    rows: DataFrame, obs: DataFrame, node: Node, seed: int, id_col: str, emb: DataFrame | None
) -> DataFrame:
    a = node.attr
    u = tagged(seed, f"value-{a}", id_col)
    if node.kind is Kind.UNIFORM_CONT:
        span = obs.agg(F.struct(F.min(a).alias("lo"), F.max(a).alias("hi"))).scalar()
        drawn = F.col("_s.lo") + u * (F.col("_s.hi") - F.col("_s.lo"))
        return rows.withColumn("_s", span).withColumn(a, drawn.cast(obs.schema[a].dataType)).drop("_s")
    if node.kind is Kind.BERNOULLI:
        rate = obs.agg(F.avg(F.col(a).cast("double"))).scalar()
        return rows.withColumn("_p", rate).withColumn(a, (u < F.col("_p")).cast(obs.schema[a].dataType)).drop("_p")
    if node.numeric:
        return _sample_numeric(rows, obs, node, seed, id_col, emb)
    if not node.parents:
        return _sample_root(rows, obs, node, seed, id_col)
    return _sample_category(rows, obs, node, seed, id_col, emb)


def _sample_numeric(
    rows: DataFrame, obs: DataFrame, node: Node, seed: int, id_col: str, emb: DataFrame | None
) -> DataFrame:
    keys, a = lookup_keys(node), node.attr
    placed = with_position(rows, node)
    asked = placed.select(*keys).distinct()
    if node.kind in EMBEDDED:
        stats = cpd_embedding.numerical(obs, node, emb, id_col, asked)
    elif not node.strict:
        stats = relaxed.numerical(obs, node, asked)
    else:
        stats = cpd.numerical(obs, node, asked)
    z = standard_normal(tagged(seed, f"z1-{a}", id_col), tagged(seed, f"z2-{a}", id_col))
    value = F.col("mean") + F.coalesce(F.col("std"), F.lit(0.0)) * z
    value = F.abs(value) if node.greater_zero else value
    out = placed.join(stats.select(*keys, "mean", "std"), keys, "left")
    return out.withColumn(a, value.cast(obs.schema[a].dataType)).drop("mean", "std", POS)


def _sample_root(rows: DataFrame, obs: DataFrame, node: Node, seed: int, id_col: str) -> DataFrame:
    a = node.attr
    mode = SEEN if node.kind is Kind.UNIFORM else ROW
    cells = rows.select(id_col, F.lit(a).alias("attr"), F.lit("").alias("key"), F.lit(mode).alias("mode"))
    cells = cells.withColumn("u", tagged(seed, f"value-{a}", id_col))
    drawn = draw(cells, seen_values(_everywhere(obs, a)), fallback=ROW)
    return rows.join(drawn.select(id_col, F.col("value").cast(obs.schema[a].dataType).alias(a)), id_col, "left")


def _everywhere(obs: DataFrame, a: str) -> DataFrame:
    value = F.col(a).cast("string").alias("value")
    return obs.groupBy(F.lit(a).alias("attr"), F.lit("").alias("key"), value).agg(F.count(F.lit(1)).alias("n"))


def _sample_category(
    rows: DataFrame, obs: DataFrame, node: Node, seed: int, id_col: str, emb: DataFrame | None
) -> DataFrame:
    """A value by the distribution that scoring uses: seen values by their rows, unseen ones with a tenth as much
    mass together, any value where nothing matches.

    Rows are told apart by what they are matched with: the band around them, or a key alone. By key go nodes
    without a band, relaxed rows that had to drop it, and rare combinations, with their borrowed rows.
    """
    a, value = node.attr, F.col(node.attr).cast("string").alias("value")
    keys = lookup_keys(node)
    placed = with_position(rows, node).select(id_col, *keys)
    here = with_position(obs, node)
    text_key = lambda columns: F.to_json(F.struct(*columns))
    in_band = points = None
    if not node.strict:
        places = relaxed.keep_matching(here, node, placed.select(*keys).distinct())
        banded, plain = relaxed.split(places, node)
        joint = here.groupBy(*keys, a).agg(F.count(F.lit(1)).alias("c"))
        pairs = relaxed.expanded(joint, node, plain).groupBy(F.lit(a).alias("attr"), F.col(relaxed.KEY).alias("key"), value)
        pairs = pairs.agg(F.sum("c").alias("n"))
        by_key = placed.join(plain, keys).select(id_col, F.col(relaxed.KEY).alias("key"))
        if node.band:
            in_band = placed.join(banded, keys).select(id_col, F.col(relaxed.KEY).alias("key"), POS)
            points = relaxed.expanded(joint, node, banded).groupBy(F.col(relaxed.KEY).alias("key"), POS, a).agg(F.sum("c").alias("n"))
    elif node.band:
        left = node.by_role(Role.CAT, Role.SOFT)
        in_band = placed.select(id_col, text_key(left).alias("key"), POS)
        points = here.groupBy(text_key(left).alias("key"), POS, a).agg(F.count(F.lit(1)).alias("n"))
        by_key, pairs = _rare_in_band(placed, obs, node, emb, id_col) if node.kind is Kind.EMB_CAT else (None, None)
        if by_key is not None:
            in_band = in_band.join(by_key.select(id_col), id_col, "left_anti")
    else:
        by_key = placed.select(id_col, text_key(keys).alias("key"))
        pairs = obs.groupBy(F.lit(a).alias("attr"), text_key(keys).alias("key"), value).agg(F.count(F.lit(1)).alias("n"))
        if node.kind is Kind.EMB_CAT:
            pairs = _with_borrowed(rows, obs, node, emb, id_col, pairs)
    parts = []
    if by_key is not None:
        parts.append(_draw_by_key(by_key, pairs, _everywhere(obs, a), a, seed, id_col))
    if in_band is not None:
        parts.append(_draw_in_band(in_band, points, obs.select(a).distinct(), a, grid_radius(node.band.radius), seed, id_col))
    drawn = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return rows.join(drawn.select(id_col, F.col("value").cast(obs.schema[a].dataType).alias(a)), id_col, "left")


def _draw_by_key(rows: DataFrame, pairs: DataFrame, everywhere: DataFrame, a: str, seed: int, id_col: str) -> DataFrame:
    """``id, value``: by the key's rows, at times an unseen value; any value for an unknown key."""
    seen = seen_values(everywhere.unionByName(pairs))
    known = seen.sizes.filter("key != ''").select("key", F.lit(True).alias("_known"))
    keyed = rows.join(known, "key", "left")
    unusual = tagged(seed, f"unseen-{a}", id_col) >= _SEEN_MASS
    cells = keyed.select(
        id_col,
        F.lit(a).alias("attr"),
        F.when(F.col("_known"), F.col("key")).otherwise("").alias("key"),
        F.when(F.col("_known").isNull(), SEEN).when(unusual, NEVER).otherwise(ROW).alias("mode"),
        tagged(seed, f"value-{a}", id_col).alias("u"),
    )
    return draw(cells, seen, fallback=ROW).select(id_col, "value")


def _rare_in_band(placed: DataFrame, obs: DataFrame, node: Node, emb: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose band holds fewer than k rows, by a key of their own, and its hit and borrowed rows as pairs."""
    left, every = node.by_role(Role.SOFT, Role.CAT), [*node.by_role(Role.SOFT, Role.CAT, Role.HARD), POS]
    points = with_position(obs, node).groupBy(*left, POS).agg(F.count(F.lit(1)).alias("n"))
    places = placed.select(*every).distinct()
    hits = band_counts(points, places.select(*left, POS).distinct(), left, POS, grid_radius(node.band.radius))
    rare = cut(places.join(hits, [*left, POS]).filter(F.col("n") < node.k))
    order = [*node.by_role(Role.SOFT), *node.by_role(Role.CAT), *node.by_role(Role.HARD), POS]
    place = F.to_json(F.struct(*order)).alias("key")
    members = cpd_embedding.members_of_rare(obs, rare.select(*order, "n"), node, emb, id_col)
    pairs = members.groupBy(F.lit(node.attr).alias("attr"), F.col(cpd_embedding.PLACE).alias("key"), F.col("_target").cast("string").alias("value"))
    rows = placed.join(rare.select(*every), every).select(id_col, place)
    return cut(rows), pairs.agg(F.count(F.lit(1)).alias("n"))


def _with_borrowed(
    rows: DataFrame, obs: DataFrame, node: Node, emb: DataFrame, id_col: str, pairs: DataFrame
) -> DataFrame:
    """Replace the counts of rare asked parents by those of their hit and borrowed rows."""
    soft, hard = node.by_role(Role.SOFT), node.by_role(Role.HARD)
    every = soft + node.by_role(Role.CAT) + hard
    hits = obs.groupBy(*[p for p in every if p not in hard]).agg(F.count(F.lit(1)).alias("n"))
    asked = rows.select(*every).distinct().join(hits, [p for p in every if p not in hard], "left")
    rare = cut(asked.withColumn("n", F.coalesce("n", F.lit(0))).filter(F.col("n") < node.k))
    if rare.isEmpty():
        return pairs
    order = [p.attr for p in node.parents]
    key = F.to_json(F.struct(*node.by_role(Role.CAT, Role.SOFT, Role.HARD))).alias("key")
    places = rare.select(key, F.to_json(F.struct(*every)).alias(cpd_embedding.PLACE))
    members = cpd_embedding.members_of_rare(obs, rare.select(*order, "n"), node, emb, id_col)
    borrowed = members.join(places, cpd_embedding.PLACE).groupBy(
        F.lit(node.attr).alias("attr"), "key", F.col("_target").cast("string").alias("value")
    )
    return pairs.join(places.select("key"), "key", "left_anti").unionByName(
        borrowed.agg(F.count(F.lit(1)).alias("n")), allowMissingColumns=True
    )


def _draw_in_band(
    rows: DataFrame, points: DataFrame, domain: DataFrame, a: str, r: int, seed: int, id_col: str
) -> DataFrame:
    """``id, value`` for rows ``id, key, position``: a random row of the band, an unseen value, or any value.

    ``points`` has the rows by (key, position, value). They are numbered in band order, so the n-th row of a band is
    found by its number; an unseen value by the count of seen ones in ever smaller ranges of the domain.
    """
    points = cut(points.withColumn("_at", F.struct(F.col(POS), F.col(a))).withColumn("upto", F.col("n")))
    chunks = chunks_for(points)
    words = domain.select(F.col(a).cast("string").alias("value"))
    numbered = cut(global_rank(words, "value", "x", chunks_for(words)))
    size = numbered.count()
    upto = running_totals(points, ["key"], "_at", {"upto": "sum"}, chunks)
    starts = cut(upto.select("key", POS, a, "n", (F.col("upto") - F.col("n")).alias("start")))
    places = cut(rows.select("key", POS).distinct())
    by_place = starts.groupBy("key", POS).agg(F.sum("n").alias("n"))
    inside = band_counts(by_place, places, ["key"], POS, r, chunks)
    below = places.select("key", (F.col(POS) - r - 1).alias(POS))
    before = totals_at(by_place, below, ["key"], POS, {"n": "sum"}, chunks).select(
        "key", (F.col(POS) + r + 1).alias(POS), F.col("n").alias("_before")
    )
    values = starts.select("key", POS, F.col(a).cast("string").alias("value")).join(numbered, "value")
    seen = band_distinct(values, places, ["key"], "x", POS, r, chunks)
    sized = rows.join(inside.join(before, ["key", POS]).join(seen, ["key", POS]), ["key", POS])
    u = tagged(seed, f"value-{a}", id_col)
    unusual = (F.col("n_values") < size) & (tagged(seed, f"unseen-{a}", id_col) >= _SEEN_MASS)
    sized = cut(sized.withColumn("_how", F.when(F.col("n") == 0, "any").when(unusual, "unseen").otherwise("seen")).withColumn("_u", u))

    nth = F.col("_before") + pick_index(F.col("_u"), F.col("n"))
    wanted = sized.filter("_how = 'seen'").select(id_col, "key", nth.alias("start"))
    entries = starts.select("key", "start", F.struct(F.col("start").alias("s"), F.col(a).cast("string").alias("v")).alias("_hit"))
    found = totals_at(entries, wanted, ["key"], "start", {"_hit": "max"}, chunks).select(id_col, F.col("_hit.v").alias("value"))

    missing = sized.filter("_how = 'unseen'").select(id_col, "key", POS, pick_index(F.col("_u"), F.lit(size) - F.col("n_values")).alias("_n"))
    numbers = _nth_missing(missing, values.select("key", POS, "x"), size, r, id_col, chunks)
    anything = sized.filter("_how = 'any'").select(id_col, pick_index(F.col("_u"), F.lit(size)).alias("x"))
    return found.unionByName(numbers.unionByName(anything).join(numbered, "x").select(id_col, "value"))


FAN = 32  # parts that a range of value numbers is cut into


def _nth_missing(asked: DataFrame, values: DataFrame, size: int, r: int, id_col: str, chunks: int) -> DataFrame:
    """``id, x``: the ``_n``-th number below ``size`` that no point (key, position, x) inside the asked band has.

    Level by level a range of numbers is cut into ``FAN`` parts. How many numbers of a part occur in the band
    is counted by merged stretches; what is left is missing, and tells in which part the n-th one lies.
    """
    width = 1
    while width * FAN < size:
        width *= FAN
    state = asked.withColumn("_base", F.lit(0).cast("long"))
    while width:
        part = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(FAN - 1).cast("long")))
        parts = state.withColumn("_j", part).withColumn("_from", F.col("_base") + F.col("_j") * width).filter(F.col("_from") < size)
        parts = parts.withColumn("_part", F.floor(F.col("_from") / width).cast("long"))
        level = values.withColumn("_part", F.floor(F.col("x") / width).cast("long"))
        places = parts.select("key", "_part", POS).distinct()
        seen = band_distinct(level, places, ["key", "_part"], "x", POS, r, chunks)
        counted = parts.join(seen, ["key", "_part", POS], "left")
        free = F.least(F.lit(width), F.lit(size) - F.col("_from")) - F.coalesce("n_values", F.lit(0))
        upto = Window.partitionBy(id_col).orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)  # FAN rows
        counted = counted.withColumn("_free", free).withColumn("_upto", F.sum("_free").over(upto))
        first = counted.filter((F.col("_upto") > F.col("_n")) & (F.col("_upto") - F.col("_free") <= F.col("_n")))
        state = cut(first.select(id_col, "key", POS, (F.col("_n") - (F.col("_upto") - F.col("_free"))).alias("_n"), F.col("_from").alias("_base")))
        width //= FAN
    return state.select(id_col, F.col("_base").alias("x"))


def impute(
    rows: DataFrame,
    obs: DataFrame,
    spec: ModelSpec,
    id_col: str,
    missing: list[str],
    particles: int,
    seed: int,
    emb: DataFrame | None = None,
) -> DataFrame:
    """Missing columns of rows, drawn from the model given the present ones; with the log evidence.

    Missing columns are drawn from the prior ``particles`` times per row, weighted by how
    probable the present columns then are, and one particle is drawn by weight.
    """
    present = [x for x in spec.attrs if x not in missing]
    copies = rows.select(F.col(id_col).alias("_row"), *present).withColumn(
        "_particle", F.explode(F.sequence(F.lit(1), F.lit(particles)))
    )
    id_type = obs.schema[id_col].dataType.typeName()
    pid = F.concat_ws("#", F.col("_row"), F.col("_particle")) if id_type == "string" else (
        F.col("_row") * particles + F.col("_particle") - 1
    )
    copies = cut(copies.withColumn(id_col, pid))
    full = sample_nodes(copies, obs, spec, missing, seed, id_col, emb)
    scored = score(obs, spec, id_col, emb, rows=full, keep=["_row"], only=present, point_mass=True)
    # NaN is left only where a column has a single value in the whole table: that node says nothing.
    weight = sum((F.when(F.isnan(lp(a)), F.lit(0.0)).otherwise(F.col(lp(a))) for a in present), F.lit(0.0))
    scored = cut(scored.select("_row", id_col, *spec.attrs, weight.alias("_lw")))
    top = scored.groupBy("_row").agg(F.max("_lw").alias("_top"))
    noise = gumbel(tagged(seed, "resample", id_col))
    both = scored.join(top, "_row").withColumn("_noisy", F.col("_lw") + noise)
    shifted = F.when(F.col("_top") == dist.neg_inf(), F.lit(0.0)).otherwise(F.exp(F.col("_lw") - F.col("_top")))
    out = both.groupBy("_row").agg(
        F.max_by(F.struct(*spec.attrs), "_noisy").alias("_b"),
        (F.first("_top") + dist.safe_ln(F.sum(shifted) / particles)).alias("log_evidence"),
    )
    return out.select(F.col("_row").alias(id_col), *[F.col(f"_b.{x}").alias(x) for x in spec.attrs], "log_evidence")


def evidence(
    rows: DataFrame, obs: DataFrame, spec: ModelSpec, id_col: str, missing: list[str], emb: DataFrame | None = None
) -> DataFrame:
    """``id, log_evidence``: the exact log probability of the present columns, whatever the missing ones are.

    Variables are eliminated one after the other. Every node that involves a missing column is a table of factors,
    a row for each row id and each combination of values of the missing columns it involves; tables that
    share the next column to go are multiplied by joins, and the column is summed out, shifted by its
    maximum. No table is larger than the domains that one node, or one elimination, brings together. Missing
    columns must be categories; nodes are judged as in ``impute``.
    """
    for a in missing:
        if spec.node(a).numeric:
            raise ValueError(f"{a} is a number; impute draws those")
    given = cut(rows.select(id_col, *[a for a in spec.attrs if a not in missing]))
    scope_of = lambda n: [a for a in missing if a == n.attr or a in [p.attr for p in n.parents]]
    factors: list[tuple[list[str], DataFrame]] = []
    for scope in dict.fromkeys(tuple(scope_of(n)) for n in spec.nodes):
        nodes = [n.attr for n in spec.nodes if tuple(scope_of(n)) == scope]
        unfolded = given
        for a in scope:
            numbered = cut(global_rank(obs.select(a).dropna().distinct(), a, "_rank"))
            unfolded = unfolded.withColumn("_size", numbered.agg(F.count(F.lit(1))).scalar())
            unfolded = unfolded.withColumn("_rank", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_size") - 1))).join(numbered, "_rank")
        # columns that no node here looks at only have to be there
        dummies = [F.lit(obs.select(a).dropna().first()[0]).cast(obs.schema[a].dataType).alias(a) for a in missing if a not in scope]
        asked = unfolded.withColumn("_row", F.col(id_col)).select(id_col, "_row", *given.columns[1:], *scope, *dummies)
        asked = cut(asked.withColumn(id_col, F.struct("_row", *scope)) if scope else asked)
        scored = score(obs, spec, id_col, emb, rows=asked, keep=["_row"], only=nodes, point_mass=True)
        lf = sum((F.when(F.isnan(lp(a)), F.lit(0.0)).otherwise(F.col(lp(a))) for a in nodes), F.lit(0.0))
        factors.append((list(scope), cut(scored.select("_row", *scope, lf.alias("_lf")))))
    for a in missing:
        mine = [f for f in factors if a in f[0]]
        factors = [f for f in factors if a not in f[0]]
        scope, product = mine[0]
        for other, table in mine[1:]:
            shared = [x for x in other if x in scope]
            product = product.join(table.withColumnRenamed("_lf", "_other"), ["_row", *shared])
            product = product.withColumn("_lf", F.col("_lf") + F.col("_other")).drop("_other")
            scope = scope + [x for x in other if x not in scope]
        scope = [x for x in scope if x != a]
        top = product.groupBy("_row", *scope).agg(F.max("_lf").alias("_top"))
        shifted = F.when(F.col("_top") == dist.neg_inf(), F.lit(0.0)).otherwise(F.exp(F.col("_lf") - F.col("_top")))
        summed = product.join(top, ["_row", *scope]).groupBy("_row", *scope).agg((F.first("_top") + dist.safe_ln(F.sum(shifted))).alias("_lf"))
        factors.append((scope, cut(summed)))
    every = factors[0][1]
    for _, table in factors[1:]:
        every = every.unionByName(table)
    return every.groupBy("_row").agg(F.sum("_lf").alias("log_evidence")).select(F.col("_row").alias(id_col), "log_evidence")


def unit_price(base: Column, year: Column, space: Column, rule: PriceRule) -> Column:
    """Price per unit of space by a rule."""
    age = F.lit(0.0)
    for step in reversed(rule.years):
        extra = F.lit(step.extra) + (year - step.start) * step.per_year
        age = F.when((year >= step.start) & (year < step.until), extra).otherwise(age)
    return base + rule.offset + age + (rule.pivot - space) * rule.slope


def facts_from_dimension(
    dim: DataFrame,
    key: str,
    base: str,
    code_low: str,
    code_high: str,
    year: str,
    n: int,
    seed: int,
    rule: PriceRule,
    observed: tuple[str, str] | None = None,
    space: tuple[float, float] = (20.0, 200.0),
    keep: list[str] = (),
) -> DataFrame:
    """``n`` fact rows: a random dimension row, a code in its range, a size, and the price by rule.

    A price below the rule's least takes the size and price of the columns ``observed`` instead.
    """
    size = dim.count()
    numbered = global_rank(dim.select(key), key, "_rank", chunks_of(size))
    picks = dim.sparkSession.range(n).withColumnRenamed("id", "fact")
    picks = picks.select("fact", pick_index(tagged(seed, "dim", "fact"), F.lit(size)).alias("_rank"))
    rows = picks.join(numbered, "_rank").join(dim, key)
    low, high = space
    code = F.col(code_low) + pick_index(tagged(seed, "code", "fact"), F.col(code_high) - F.col(code_low) + 1)
    area = low + tagged(seed, "space", "fact") * (high - low)
    out = rows.withColumn("_code", code).withColumn("_a", area)
    out = out.withColumn("_p", F.col("_a") * unit_price(F.col(base), F.col(year), F.col("_a"), rule))
    a, p = F.col("_a"), F.col("_p")
    if observed:
        a, p = (F.when(F.col("_p") < rule.least, F.col(o)).otherwise(c) for o, c in zip(observed, (a, p)))
    return out.select(
        "fact", key, *keep, F.col("_code").alias("code"), F.col(year).alias("year"), F.round(a, 2).alias("space"), F.round(p, 2).alias("price")
    )


def first_n_per_key(df: DataFrame, key: str, order: str, n: int, condition: Column) -> DataFrame:
    """The first ``n`` rows of each key, then those that meet a condition; all rows of the key count."""
    w = Window.partitionBy(key).orderBy(order)
    first = df.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= n).drop("_i")
    return first.filter(condition)
