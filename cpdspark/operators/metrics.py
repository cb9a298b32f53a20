"""Precision, PR and ROC of a ranked list of suspects.

Every function takes ``by`` columns, so a sweep over settings is one job with the setting as a
column. Curves are running totals over the whole table and use chunked running totals, since
neither the table nor one setting need fit a task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cpdspark.functions.distributions import safe_div
from cpdspark.functions.lineage import cut
from cpdspark.functions.rng import unit
from cpdspark.operators.cumulative import chunks_for, running_totals


def base_rate(df: DataFrame, label: str, *by: str) -> DataFrame:
    """Precision of a random ranking: the share of labelled rows."""
    return df.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("base_rate"))


def injected_base_rate(k: float) -> float:
    """Share of injected rows when ``k`` times the clean rows were added."""
    return k / (1.0 + k)


def ranked(scored: DataFrame, label: str, id_col: str, by: list[str] = (), chunks: int | None = None) -> DataFrame:
    """Scored rows with ``tp`` and ``fp``, the labelled and unlabelled rows up to here."""
    rows = cut(scored.filter(F.col("score").isNotNull()).select(
        *by,
        F.struct("score", F.col(id_col).alias("id")).alias("_at"),
        F.col(label).cast("long").alias("label"),
        F.col(label).cast("long").alias("tp"),
        (1 - F.col(label)).cast("long").alias("fp"),
    ))
    chunks = chunks_for(rows) if chunks is None else chunks
    out = running_totals(rows, list(by), "_at", {"tp": "sum", "fp": "sum"}, chunks)
    return out.select(*by, F.col("_at.id").alias(id_col), F.col("_at.score").alias("score"), "label", "tp", "fp")


def pr_roc(scored: DataFrame, label: str, id_col: str, by: list[str] = (), chunks: int | None = None) -> DataFrame:
    """``precision, recall, fpr`` after each row in score order, and the point before."""
    points = ranked(scored, label, id_col, by, chunks)
    sums = [F.sum("label").alias("_p"), F.sum(1 - F.col("label")).alias("_n")]
    if by:
        totals = points.groupBy(*by).agg(*sums)
        points = points.join(totals, list(by))
    else:
        totals = points.agg(F.struct(*sums).alias("_t")).scalar()
        points = points.withColumn("_t", totals).withColumn("_p", F.col("_t._p")).withColumn("_n", F.col("_t._n"))
    share = lambda a, b: safe_div(a.cast("double"), b.cast("double"))
    tp, fp, p, n = (F.col(c) for c in ("tp", "fp", "_p", "_n"))
    return points.select(
        *by,
        id_col,
        "score",
        "label",
        "tp",
        "fp",
        share(tp, tp + fp).alias("precision"),
        share(tp, p).alias("recall"),
        share(fp, n).alias("fpr"),
        share(tp - F.col("label"), p).alias("prev_recall"),
        share(fp - 1 + F.col("label"), n).alias("prev_fpr"),
        share(tp - F.col("label"), tp + fp - 1).alias("prev_precision"),
    )


def roc_auc(points: DataFrame, by: list[str] = ()) -> DataFrame:
    """Trapezoid area of recall over fpr; the area starts at the first point."""
    return _area(points, "fpr", "recall", by)


def _area(points: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    step = (F.col(x) - F.col(f"prev_{x}")) * (F.col(y) + F.col(f"prev_{y}")) / 2
    first = F.col("tp") + F.col("fp") == 1
    return points.groupBy(*by).agg(F.sum(F.when(first, F.lit(0.0)).otherwise(step)).alias("auc"))


def precision_at_k(
    scored: DataFrame, label: str, id_col: str, k: int | None = None, by: list[str] = (), chunks: int | None = None
) -> DataFrame:
    """Share of labelled rows among the k lowest scores, and their recall.

    Without ``k`` it is the number of labelled rows, so that precision equals recall; where there is no such
    row, it is 0 and the shares are null. Works from
    ranks, not from a sorted list in one task, as k may be a fixed share of a large table.
    """
    points = pr_roc(scored, label, id_col, by, chunks)
    depth = F.col("tp") + F.col("fp")
    # recall = tp / P, so P is known in every row that has a hit so far.
    wanted = F.round(F.col("tp") / F.when(F.col("tp") > 0, F.col("recall"))).cast("long") if k is None else F.lit(k)
    at = F.struct(depth.alias("k"), F.col("precision"), F.col("recall"))
    best = F.max(F.when(depth == wanted, at))
    if k is None:
        unknown = F.lit(None).cast("double")
        none = F.struct(F.lit(0).cast("long").alias("k"), unknown.alias("precision"), unknown.alias("recall"))
        best = F.coalesce(best, F.when(F.max("tp") == 0, none))
    best = points.groupBy(*by).agg(best.alias("_at"))
    return best.select(*by, "_at.*")


def shuffled(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Rows in a random order that depends on the seed and the ids only."""
    return df.orderBy(unit(seed, id_col), id_col)


def shuffled_places(df: DataFrame, id_col: str, seed: int) -> DataFrame:
    """``id, place``: where each row stands in :func:`shuffled`, from 1; counted in chunks, not in one task."""
    rows = df.select(id_col, F.struct(unit(seed, id_col).alias("u"), F.col(id_col)).alias("_at"), F.lit(1).cast("long").alias("place"))
    return running_totals(rows, [], "_at", {"place": "sum"}).select(id_col, "place")
