"""Labelled errors: rows whose values do not go together, for evaluation and training."""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F, types as T

from cpdspark.functions.lineage import cut
from cpdspark.functions.rng import pick_index, tagged
from cpdspark.operators.cumulative import chunks_of, global_rank, rank_in
from cpdspark.operators.draws import NEVER, ROW, SEEN, WITHIN, draw, pairs_of, seen_values, widen

LABEL = "negative_sample"

_log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Setting:
    """One evaluation table: its name, chance ``p``, its copies (a number or a share), and its size in rows."""

    name: str
    p: float
    n: int | None = None
    share: float | None = None
    size: int | None = None  # of rows drawn from the table; all of them where it is None


def inject_errors(
    df: DataFrame,
    id_col: str,
    pivot: str,
    attrs: list[str],
    p: float,
    seed: int,
    share: float | None = None,
    n: int | None = None,
    shift: dict[str, float] | None = None,
    force: str = "random",
    label: str = LABEL,
) -> DataFrame:
    """The table with label 0, and corrupted copies of random rows with label 1.

    Each listed attribute of a copy is, with chance ``p``, replaced by a value that never occurs
    with the copy's pivot value, plus a ``shift`` if one is given. Only attributes count of which some
    value never occurs with the pivot value. A copy that came out unharmed gets one random of these
    replaced (``force="random"``) or the last of them (``"last"``). ``n``, or ``ceil(share * rows)``, copies
    are drawn, with replacement, among the rows that have such an attribute. Where no row has one, the
    copies are drawn among all rows and stay unharmed with label 0, and a warning gives their number.
    """
    if (share is None) == (n is None):
        raise ValueError("give either share or n")
    setting = Setting("", p, n, share)
    return inject_grid(df, id_col, pivot, attrs, [setting], seed, shift, force, label).drop("scenario")


def inject_grid(
    df: DataFrame,
    id_col: str,
    pivot: str,
    attrs: list[str],
    settings: list[Setting],
    seed: int,
    shift: dict[str, float] | None = None,
    force: str = "random",
    label: str = LABEL,
) -> DataFrame:
    """``inject_errors`` for many settings in one plan; ``scenario`` is the setting's name.

    The scenario is a key of the plan, not a loop: what occurs with a pivot value is counted once for each
    size, copies are drawn once for each size, and a drawn value serves all settings that need it. A smaller
    size is a part of every larger one, and so are the copies of a smaller share.
    """
    if force not in ("random", "last"):
        raise ValueError("force must be 'random' or 'last'")
    sizes = list(dict.fromkeys(_size_key(x) for x in settings))
    rows = _sized_rows(df, id_col, seed, sizes).withColumn("_pivot", F.col(pivot).cast("string"))
    rows = cut(rows) if sizes != [WHOLE] else rows
    n_rows = {r._size: r["count"] for r in rows.groupBy("_size").count().collect()}
    copies_of = lambda x: math.ceil(x.share * n_rows.get(_size_key(x), 0)) if x.n is None else x.n * (_size_key(x) in n_rows)

    seen = seen_values(pairs_of(rows, pivot, attrs, within="_size"))
    of_attr = F.substring_index("attr", WITHIN, 1).cast("int").alias("_size")
    free = cut(seen.sizes.filter("n_never > 0").groupBy(of_attr, F.col("key").alias("_pivot")).agg(F.collect_set("attr").alias("_free")))
    known = cut(rows.join(free, ["_size", "_pivot"], "left"))
    harmed = known.filter("_free IS NOT NULL").groupBy("_size").count().collect()
    n_free = {r._size: r["count"] for r in harmed}
    for x in settings:
        if copies_of(x) and _size_key(x) not in n_free:
            _log.warning("0 of %d errors injected%s: every value of %s occurs with every %s", copies_of(x), x.name and f" for {x.name}", ", ".join(attrs), pivot)
    pool = {s: n_free.get(s, n) for s, n in n_rows.items()}
    most = {s: max(copies_of(x) for x in settings if _size_key(x) == s) for s in pool}
    eligible = F.lit(False)
    for s in pool:
        eligible = eligible | ((F.col("_size") == s) & (F.col("_free").isNotNull() | F.lit(s not in n_free)))
    copies = cut(_pick_rows(known.filter(eligible), id_col, pool, most, seed))

    applied = F.array(*[_struct(_size=_size_key(x), scenario=x.name, n=copies_of(x), p=float(x.p)) for x in settings])
    own = F.filter(applied, lambda x: (x["_size"] == F.col("_size")) & (x["n"] > F.col("draw")))
    flagged = copies.select("draw", "_size", F.col("_pivot").alias("key"), "_free", F.explode(own).alias("_s"))
    flagged = flagged.select("draw", "key", "_s.scenario", F.explode(F.array(*_flags(attrs, F.col("_s.p"), seed, force))).alias("_c"))
    hits = cut(flagged.filter("_c.hit").select("draw", "scenario", "key", F.col("_c.attr").alias("attr")))
    wanted = hits.select("draw", "key", "attr").distinct()
    cells = wanted.select(
        "draw", "key", "attr", F.lit(NEVER).alias("mode"), tagged(seed, "value", F.substring_index("attr", WITHIN, -1), "draw").alias("u")
    )
    values = hits.join(draw(cells, seen), ["draw", "attr"]).withColumn("attr", F.substring_index("attr", WITHIN, -1))
    new = widen(values, ["draw", "scenario"], df.schema, attrs)

    bad = copies.withColumn("_s", F.explode(own)).withColumn("scenario", F.col("_s.scenario")).join(new, ["draw", "scenario"], "left")
    for a in attrs:
        value = F.col("_new_" + a)
        if shift and a in shift:
            value = value + F.lit(shift[a])
        bad = bad.withColumn(a, F.coalesce(value, F.col(a)).cast(df.schema[a].dataType))
    bad = bad.withColumn(id_col, _copy_id(df, id_col)).withColumn(label, F.col("_free").isNotNull().cast("int"))
    named = F.filter(F.array(*[_struct(_size=_size_key(x), scenario=x.name) for x in settings]), lambda x: x["_size"] == F.col("_size"))
    clean = rows.withColumn("_s", F.explode(named)).withColumn(label, F.lit(0)).withColumn("scenario", F.col("_s.scenario"))
    columns = [*df.columns, label, "scenario"]
    return clean.select(*columns).unionByName(bad.select(*columns))


WHOLE = -1  # the key of the table's own size


def _size_key(x: Setting) -> int:
    return WHOLE if x.size is None else x.size


def _struct(**values) -> Column:
    return F.struct(*[F.lit(v).alias(k) for k, v in values.items()])


def _sized_rows(df: DataFrame, id_col: str, seed: int, sizes: list[int]) -> DataFrame:
    """The rows of every size, with ``_size``; a size takes the rows of least hash, by rank and not by a sort."""
    if sizes == [WHOLE]:
        return df.withColumn("_size", F.lit(WHOLE))
    at = F.struct(tagged(seed, "size", id_col).alias("u"), F.col(id_col))
    ranked = global_rank(df.withColumn("_at", at), "_at", "_place")
    within = F.filter(F.array(*[F.lit(s) for s in sizes]), lambda s: (s == WHOLE) | (s > F.col("_place")))
    return ranked.select(*df.columns, F.explode(within).alias("_size"))


def _pick_rows(rows: DataFrame, id_col: str, pool: dict[int, int], most: dict[int, int], seed: int) -> DataFrame:
    """``most`` of each size's ``pool`` rows, drawn with replacement; ``draw`` numbers the draws."""
    numbered = rank_in(rows.select("_size", id_col), ["_size"], id_col, "_rank", chunks_of(sum(pool.values())))
    of_size = F.filter(
        F.array(*[_struct(_size=s, most=most[s], pool=pool[s]) for s in pool] or [_struct(_size=WHOLE, most=0, pool=0)]),
        lambda x: x["most"] > F.col("draw"),
    )
    picks = rows.sparkSession.range(max(most.values(), default=0)).withColumnRenamed("id", "draw")
    picks = picks.select("draw", F.explode(of_size).alias("_p"))
    picks = picks.select("draw", "_p._size", pick_index(tagged(seed, "row", "draw"), F.col("_p.pool")).alias("_rank"))
    return picks.join(numbered, ["_size", "_rank"]).drop("_rank").join(rows, ["_size", id_col])


def _copy_id(df: DataFrame, id_col: str) -> Column:
    """Ids that no original row has: negative numbers, or texts with a mark."""
    kind = df.schema[id_col].dataType
    if isinstance(kind, T.StringType):
        return F.concat(F.lit("copy-"), F.col("draw").cast("string"))
    return (-F.col("draw") - 1).cast(kind)


def _flags(attrs: list[str], p: Column, seed: int, force: str) -> list[Column]:
    """Which attributes of a copy are replaced; ``_free`` holds those that can be, each with its size before it."""
    full = [F.concat_ws(WITHIN, "_s._size", F.lit(a)) for a in attrs]
    free = [F.coalesce(F.array_contains("_free", a), F.lit(False)) for a in full]
    own = [f & (tagged(seed, "flip", F.lit(a), "draw") < p) for a, f in zip(attrs, free)]
    none = ~_any(own)
    size = F.size("_free")
    forced = pick_index(tagged(seed, "forced", "draw"), size) if force == "random" else size - 1
    before, out = F.lit(0), []
    for a, f, hit in zip(full, free, own):
        out.append(F.struct(a.alias("attr"), (hit | (none & f & (forced == before))).alias("hit")))
        before = before + f.cast("int")
    return out


def _any(flags: list[Column]) -> Column:
    out = F.lit(False)
    for f in flags:
        out = out | f
    return out


def _per_pivot(df: DataFrame, pivot: str, n: int) -> DataFrame:
    """``n`` numbered rows for every value of the pivot."""
    pivots = df.select(F.col(pivot).cast("string").alias("key")).dropna().distinct()
    return pivots.select("key", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("draw"))


def _cell(attr: str, mode: Column | str, seed: int) -> Column:
    mode = F.lit(mode) if isinstance(mode, str) else mode
    u = tagged(seed, "value", F.lit(attr), "key", "draw")
    return F.struct(F.lit(attr).alias("attr"), mode.alias("mode"), u.alias("u"))


def _rows_from_cells(df: DataFrame, pivot: str, cells: list[Column], n: int, fallback: str | None) -> DataFrame:
    attrs = [c for c in df.columns if c != pivot]
    long = _per_pivot(df, pivot, n).select("key", "draw", F.explode(F.array(*cells)).alias("_c"))
    long = long.select(
        "draw",
        F.col("key").alias("_pivot"),
        "key",
        F.col("_c.attr").alias("attr"),
        F.col("_c.mode").alias("mode"),
        F.col("_c.u").alias("u"),
    )
    drawn = draw(long, seen_values(pairs_of(df, pivot, attrs)), fallback)
    wide = widen(drawn, ["_pivot", "draw"], df.schema, attrs, prefix="")
    return wide.select(F.col("_pivot").cast(df.schema[pivot].dataType).alias(pivot), "draw", *attrs)


def errors_per_pivot(
    df: DataFrame, pivot: str, ignore: list[str], n: int, seed: int, q: float = 0.1, label: str = LABEL
) -> DataFrame:
    """``n`` bad rows for every pivot value.

    One random attribute gets a value never seen with the pivot, each other one with chance ``q``,
    the rest and the ignored attributes get values seen with it. The table must hold only the
    pivot, the attributes and the ignored attributes.
    """
    attrs = [c for c in df.columns if c != pivot and c not in ignore]
    bad = pick_index(tagged(seed, "bad", "key", "draw"), F.lit(len(attrs)))
    cells = []
    for i, a in enumerate(attrs):
        also = tagged(seed, "also", F.lit(a), "key", "draw") < q
        cells.append(_cell(a, F.when((bad == i) | also, F.lit(NEVER)).otherwise(F.lit(SEEN)), seed))
    cells += [_cell(a, SEEN, seed) for a in ignore]
    return _rows_from_cells(df, pivot, cells, n, SEEN).withColumn(label, F.lit(1))


def training_negatives(df: DataFrame, pivot: str, ignore: list[str], n: int, seed: int) -> DataFrame:
    """``n`` rows per pivot value whose other attributes never occur with it (``good = 0``).

    Where every value occurs, a seen one is taken. Ignored attributes come from the pivot's rows.
    """
    attrs = [c for c in df.columns if c != pivot and c not in ignore]
    cells = [_cell(a, NEVER, seed) for a in attrs] + [_cell(a, ROW, seed) for a in ignore]
    return _rows_from_cells(df, pivot, cells, n, SEEN).withColumn("good", F.lit(0))


def training_set(df: DataFrame, pivot: str, ignore: list[str], n: int, seed: int) -> DataFrame:
    """Observed rows with ``good = 1`` and negatives with ``good = 0``."""
    negatives = training_negatives(df, pivot, ignore, n, seed).drop("draw")
    return df.withColumn("good", F.lit(1)).unionByName(negatives)


def scenarios(
    df: DataFrame,
    id_col: str,
    pivot: str,
    attrs: list[str],
    shares: list[float],
    ps: list[float],
    seed: int,
    shift: dict[str, float] | None = None,
    sizes: list[int] | None = None,
) -> DataFrame:
    """One evaluation table per (size, share, p), told apart by ``scenario``, in one plan.

    A size is a number of rows, drawn by a hash of the id; without sizes it is the whole table.
    """
    name = lambda s, k, p: f"k={k},p={p}" if s is None else f"s={s},k={k},p={p}"
    grid = [Setting(name(s, k, p), p, share=k, size=s) for s in sizes or [None] for k in shares for p in ps]
    return inject_grid(df, id_col, pivot, attrs, grid, seed, shift)
