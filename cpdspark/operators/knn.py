"""Exact nearest neighbours by cosine distance, in bounded blocks.

Two indexes keep queries from meeting every candidate:

* Values of one attribute lie in cells around pivots, by angle. Angles obey the triangle inequality, so a
  cell whose ring of angles is too far from a query's angle to its pivot cannot hold a nearer value. A query
  first asks the cells that may be nearest, until they hold enough values, then all that the bound leaves.
* Rows with several attributes are found by a threshold search in rounds. A round brings each query together
  with the candidates that have one of the ``depth`` nearest values in some attribute. What it has not met
  is at least as far as the sum of the next values' distances, so a query whose farthest neighbour
  is nearer than that is done; the others look four times as deep.

Queries and candidates that do meet (in a cell, or by a value within equal hard attributes and
neighbouring band buckets) are cut into chunks of fixed size. Each pair of chunks is one small numpy task that
returns only the nearest rows of every query; no list of all pairs exists. Results of the chunks are merged by a
ranked window. Distances are rounded to 12 digits, and ties go to the smaller id, so that the
result does not depend on how the work was cut. The cosine of concatenated vectors has no such bound by attribute;
there all chunks of a block are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from cpdspark.functions.lineage import cut

QUERY_CHUNK = 2048
CANDIDATE_CHUNK = 8192
_SLICE_CELLS = 2_000_000
_ROUND = 12
CELL = 512  # values of a cell, about
MAX_PIVOTS = 4096  # of an attribute; with vectors of 100 numbers these are 3 MB
FIRST_DEPTH, DEEPER = 4, 4
_MARGIN = 1e-6  # of angles, above the error of an arc cosine


def vector_column(attr: str) -> str:
    return f"_vec_{attr}"


def with_vectors(df: DataFrame, emb: DataFrame, attrs: list[str], missing: str = "error") -> DataFrame:
    """Look up each attribute's vector by (attr, value). ``missing``: ``error`` or ``null``."""
    if missing not in ("error", "null"):
        raise ValueError("missing must be 'error' or 'null'")
    for a in attrs:
        v = vector_column(a)
        lookup = emb.filter(F.col("attr") == a).select(F.col("value").alias("_value"), F.col("vec").alias(v))
        df = df.join(lookup, F.col(a).cast("string") == F.col("_value"), "left").drop("_value")
        if missing == "error":
            message = F.concat(F.lit(f"no vector for {a}="), F.col(a).cast("string"))
            df = df.withColumn(
                v, F.when(F.col(v).isNull() & F.col(a).isNotNull(), F.raise_error(message)).otherwise(F.col(v))
            )
    return df


def replace_with_vectors(df: DataFrame, emb: DataFrame, cats: list[str], nums: list[str]) -> DataFrame:
    """Table of the listed columns with categories replaced by their vectors."""
    wide = with_vectors(df, emb, cats)
    return wide.select(*[F.col(vector_column(a)).alias(a) for a in cats], *nums)


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    attrs: list[str],
    block: list[str] = (),
    need: Column | None = None,
    k: int | None = None,
    pos: str | None = None,
    radius: int = 0,
    exclude_equal: bool = True,
    concatenated: bool = False,
    payload: list[str] = (),
) -> DataFrame:
    """Nearest candidates per query: ``qid, cid, dist, rank`` and the candidates' payload.

    ``queries`` has ``qid``, ``candidates`` has ``cid``; both have the block columns, the
    attributes, their vector columns and, with a radius, the position. Distance is the sum of the
    attributes' absolute cosine distances, or the cosine distance of the concatenated vectors.
    A candidate equal in all attributes is left out unless ``exclude_equal`` is off. Fewer
    candidates than wanted means all of them.
    """
    vecs = [vector_column(a) for a in attrs]
    place = [pos] if pos else []
    q = queries.select("qid", *block, *attrs, *vecs, *place, (need if need is not None else F.lit(k)).alias("_need"))
    c = candidates.select("cid", *block, *attrs, *vecs, *place, *payload)
    keys = list(block)
    if pos:
        bucket = F.floor(F.col(pos) / F.lit(radius)).cast("long")
        q = q.withColumn("_bucket", F.explode(F.array(bucket - 1, bucket, bucket + 1)))
        c = c.withColumn("_bucket", bucket)
        keys.append("_bucket")
    how = (attrs, pos, radius, exclude_equal, concatenated, list(payload))
    found = _compared(q, c, keys, *how) if concatenated or not attrs else _in_rounds(q, c, keys, *how)
    return _best(found).drop("_need")


def _best(found: DataFrame) -> DataFrame:
    """The nearest of each query with their rank; a pair that was found twice counts once."""
    rank = F.dense_rank().over(Window.partitionBy("qid").orderBy("dist", "cid"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= F.col("_need")).dropDuplicates(["qid", "rank"])


def _compared(
    q: DataFrame,
    c: DataFrame,
    keys: list[str],
    attrs: list[str],
    pos: str | None,
    radius: int,
    exclude_equal: bool,
    concatenated: bool,
    payload: list[str],
) -> DataFrame:
    """All pairs with equal keys, of which each query's nearest in each chunk: ``qid, cid, dist, _need`` and payload."""
    q, c, group = _chunked(q, c, keys)
    schema = T.StructType(
        [T.StructField("qid", q.schema["qid"].dataType), T.StructField("cid", c.schema["cid"].dataType)]
        + [T.StructField("dist", T.DoubleType()), T.StructField("_need", T.LongType())]
        + [c.schema[p] for p in payload]
    )

    def task(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        parts = list(_nearest_in_chunk(left, right, attrs, pos, radius, exclude_equal, concatenated, payload))
        return pd.concat(parts) if parts else pd.DataFrame({f.name: [] for f in schema})

    return q.groupBy(*group).cogroup(c.groupBy(*group)).applyInPandas(task, schema)


def _pairs_of_attrs(df: DataFrame, attrs: list[str]) -> Column:
    each = [
        F.struct(F.lit(i).alias("i"), F.lit(a).alias("attr"), F.col(a).cast("string").alias("value"), F.col(vector_column(a)).alias("vec"))
        for i, a in enumerate(attrs)
    ]
    return F.array(*each)


def _values_of(df: DataFrame, attrs: list[str]) -> DataFrame:
    """``attr, value, vec``: the distinct values of the attributes."""
    long = df.select(F.explode(_pairs_of_attrs(df, attrs)).alias("v"))
    return long.groupBy("v.attr", "v.value").agg(F.first("v.vec").alias("vec"))


def _in_rounds(q: DataFrame, c: DataFrame, keys: list[str], attrs: list[str], *how) -> DataFrame:
    q, c = cut(q), cut(c)
    asked, listed = cut(_values_of(q, attrs)), cut(_values_of(c, attrs))
    by_value = c.withColumn("_v", F.explode(_pairs_of_attrs(c, attrs)))
    by_value = by_value.select(*c.columns, F.col("_v.attr").alias("_attr"), F.col("_v.value").alias("_near"))
    found, undone, before, depth, known = None, q, 0, FIRST_DEPTH, 0
    while True:
        if known <= depth:  # lists for this round and the next
            known = depth * DEEPER + 1
            lists = cut(nearest_values(asked, listed, known))
        near = lists.filter((F.col("rank") > before) & (F.col("rank") <= depth))
        near = near.select(F.col("attr").alias("_attr"), F.col("value").alias("_value"), F.col("neighbour").alias("_near"))
        each = undone.withColumn("_v", F.explode(_pairs_of_attrs(undone, attrs)))
        each = each.select(*undone.columns, F.col("_v.i").alias("_i"), F.col("_v.attr").alias("_attr"), F.col("_v.value").alias("_value"))
        meeting = each.join(near, ["_attr", "_value"]).select(*undone.columns, "_attr", "_near")
        new = _compared(meeting, by_value, [*keys, "_attr", "_near"], attrs, *how)
        found = cut(_best(new if found is None else new.unionByName(found)).drop("rank"))

        ends = lists.filter(F.col("rank") == depth + 1).select(F.col("attr").alias("_attr"), F.col("value").alias("_value"), F.col("dist").alias("_end"))
        ordered = F.array_sort(F.collect_set(F.struct("_i", "_end")))  # a query may be in several buckets
        bounds = each.join(ends, ["_attr", "_value"], "left").groupBy("qid").agg(
            F.max(F.col("_end").isNull()).alias("_all_met"), F.aggregate(ordered, F.lit(0.0), lambda total, x: total + x["_end"]).alias("_unmet")
        )
        worst = found.groupBy("qid").agg(F.count(F.lit(1)).alias("_n"), F.max("dist").alias("_worst"))
        state = undone.join(bounds, "qid").join(worst, "qid", "left")
        lacking = F.coalesce(F.col("_n") < F.col("_need"), F.lit(True)) | (F.col("_worst") >= F.col("_unmet"))
        undone = cut(state.filter(~F.col("_all_met") & lacking & (F.col("_need") > 0)).select(*q.columns))
        if undone.isEmpty():
            return found
        before, depth = depth, depth * DEEPER


def _chunked(q: DataFrame, c: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Cut both sides into chunks and copy each chunk to its partner chunks."""
    if not keys:
        q, c, keys = q.withColumn("_all", F.lit(0)), c.withColumn("_all", F.lit(0)), ["_all"]
    pieces = lambda n, size: F.ceil(n / F.lit(size)).cast("int")
    nq = q.groupBy(*keys).agg(pieces(F.count(F.lit(1)), QUERY_CHUNK).alias("_nq"))
    nc = c.groupBy(*keys).agg(pieces(F.count(F.lit(1)), CANDIDATE_CHUNK).alias("_nc"))
    sizes = nq.join(nc, keys)
    q = q.join(sizes, keys).withColumn("_qc", F.pmod(F.xxhash64("qid"), F.col("_nq")))
    q = q.withColumn("_cc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nc").cast("long") - 1)))
    c = c.join(sizes, keys).withColumn("_cc", F.pmod(F.xxhash64("cid"), F.col("_nc")))
    c = c.withColumn("_qc", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nq").cast("long") - 1)))
    # New column identities: both sides may come from the same table.
    fresh = lambda d: d.select(*[F.col(x).alias(x) for x in d.columns if x not in ("_nq", "_nc")])
    return fresh(q), fresh(c), [*keys, "_qc", "_cc"]


def _nearest_in_chunk(
    q: pd.DataFrame,
    c: pd.DataFrame,
    attrs: list[str],
    pos: str | None,
    radius: int,
    exclude_equal: bool,
    concatenated: bool,
    payload: list[str],
) -> Iterator[pd.DataFrame]:
    if q.empty or c.empty:
        return
    c = c.sort_values("cid", kind="stable")
    width = int(q["_need"].max())
    step = max(1, _SLICE_CELLS // len(c))
    table = _ConcatDistances(q, c, attrs) if concatenated else _SumDistances(q, c, attrs)
    same_q, same_c = _shared_codes(q, c, attrs)
    for start in range(0, len(q), step):
        rows = slice(start, start + step)
        dist = table.slice(rows)
        if exclude_equal and attrs:
            dist[same_q[rows, None] == same_c[None, :]] = np.inf
        if pos:
            gap = np.abs(q[pos].to_numpy()[rows, None] - c[pos].to_numpy()[None, :])
            dist[gap > radius] = np.inf
        yield _smallest(q.iloc[rows], c, dist, width, payload)


def _smallest(q: pd.DataFrame, c: pd.DataFrame, dist: np.ndarray, width: int, payload: list[str]) -> pd.DataFrame:
    """Up to ``width`` finite smallest cells per row; columns are in id order, so ties are settled."""
    if width < dist.shape[1]:
        limit = np.partition(dist, width - 1, axis=1)[:, width - 1 : width]
        keep = (dist <= limit) & np.isfinite(dist)
    else:
        keep = np.isfinite(dist)
    qi, ci = np.nonzero(keep)
    d = dist[qi, ci]
    order = np.lexsort((ci, d, qi))
    qi, ci, d = qi[order], ci[order], d[order]
    first = np.searchsorted(qi, qi, side="left")
    top = (np.arange(len(qi)) - first) < width
    qi, ci, d = qi[top], ci[top], d[top]
    out = {
        "qid": q["qid"].to_numpy()[qi],
        "cid": c["cid"].to_numpy()[ci],
        "dist": d,
        "_need": q["_need"].to_numpy()[qi],
    }
    out.update({p: c[p].to_numpy()[ci] for p in payload})
    return pd.DataFrame(out)


def _shared_codes(q: pd.DataFrame, c: pd.DataFrame, attrs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """One code per combination of attribute values, common to both sides."""
    both = np.zeros(len(q) + len(c), dtype=np.int64)
    for a in attrs:
        codes, uniques = pd.factorize(pd.concat([q[a], c[a]], ignore_index=True))
        both = pd.factorize(both * (len(uniques) + 1) + codes)[0].astype(np.int64)
    return both[: len(q)], both[len(q) :]


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - cosine for all rows of a and b; summed along the vectors, so each cell is reproducible.

    A zero vector has no direction and is at distance 1 from all.
    """
    out = np.empty((len(a), len(b)))
    na, nb = np.sqrt((a * a).sum(-1)), np.sqrt((b * b).sum(-1))
    step = max(1, _SLICE_CELLS // max(1, b.size))
    for i in range(0, len(a), step):
        dots = (a[i : i + step, None, :] * b[None, :, :]).sum(-1)
        with np.errstate(divide="ignore", invalid="ignore"):
            norms = na[i : i + step, None] * nb[None, :]
            out[i : i + step] = np.where(norms > 0, 1.0 - dots / norms, 1.0)
    return out


class _SumDistances:
    """Sum over attributes; each attribute is worked out once per pair of distinct values."""

    def __init__(self, q: pd.DataFrame, c: pd.DataFrame, attrs: list[str]):
        self.shape = (len(q), len(c))
        self.parts = []
        for a in attrs:
            v = vector_column(a)
            qc, qfirst = _first_index(q[a])
            cc, cfirst = _first_index(c[a])
            between = _cosine(np.stack(q[v].to_numpy()[qfirst]), np.stack(c[v].to_numpy()[cfirst]))
            self.parts.append((np.round(np.abs(between), _ROUND), qc, cc))

    def slice(self, rows: slice) -> np.ndarray:
        n = len(range(*rows.indices(self.shape[0])))
        total = np.zeros((n, self.shape[1]))
        for between, qc, cc in self.parts:
            total += between[qc[rows]][:, cc]
        return total


class _ConcatDistances:
    """One distance of the attributes' vectors laid end to end (signed, as computed)."""

    def __init__(self, q: pd.DataFrame, c: pd.DataFrame, attrs: list[str]):
        join = lambda d: np.concatenate([np.stack(d[vector_column(a)].to_numpy()) for a in attrs], axis=1)
        self.q, self.c = join(q), join(c)

    def slice(self, rows: slice) -> np.ndarray:
        return np.round(_cosine(self.q[rows], self.c), _ROUND)


def _first_index(values: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    codes, uniques = pd.factorize(values)
    first = np.full(len(uniques), -1)
    first[codes[::-1]] = np.arange(len(codes))[::-1]
    return codes, first


class _Pivots:
    """Pivots of an attribute, and what is known of the cells around them."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        self.least, self.greatest = np.full(len(vectors), np.inf), np.full(len(vectors), -np.inf)
        self.n, self.zeros = np.zeros(len(vectors), np.int64), 0

    def angles(self, vectors: np.ndarray) -> np.ndarray:
        return np.arccos(np.clip(1.0 - _cosine(vectors, self.vectors), -1.0, 1.0))

    def bounds(self, vector: np.ndarray) -> np.ndarray:
        """Least angle that a value of each cell can have to a vector; infinite for empty cells."""
        if not vector.any():
            return np.where(self.n > 0, 0.0, np.inf)
        at = self.angles(vector[None, :])[0]
        return np.where(self.n > 0, np.maximum(0.0, np.maximum(at - self.greatest, self.least - at)), np.inf)


ZEROS = -1  # the cell of vectors without a direction, which every query asks


def _pivots(values: DataFrame) -> dict[str, _Pivots]:
    """Some values of each attribute, by a hash: one of ``CELL``, and ``MAX_PIVOTS`` at most in expectation."""
    hashed = values.withColumn("_h", F.pmod(F.xxhash64("attr", "value"), F.lit(1 << 40)))
    hashed = hashed.filter(F.exists("vec", lambda x: x != 0.0))
    sizes = hashed.groupBy("attr").agg(F.count(F.lit(1)).alias("_n"), F.min("_h").alias("_first"))
    share = F.least(F.lit(1.0) / CELL, F.lit(float(MAX_PIVOTS)) / F.col("_n"))
    chosen = hashed.join(sizes, "attr").filter((F.col("_h") < share * float(1 << 40)) | (F.col("_h") == F.col("_first")))
    rows = chosen.select("attr", "value", "vec").orderBy("attr", "value").collect()
    return {a: _Pivots(np.array([r.vec for r in rows if r.attr == a], float)) for a in {r.attr for r in rows}}


def nearest_values(asked: DataFrame, values: DataFrame, k: int, exclude_equal: bool = False) -> DataFrame:
    """The k nearest ``values`` of the same attribute for every asked value: ``attr, value, neighbour, dist, rank``.

    Both tables are distinct (attr, value, vec).
    """
    pivots = _pivots(values)

    @F.pandas_udf("struct<cell:int,angle:double>")
    def placed(attr: pd.Series, vec: pd.Series) -> pd.DataFrame:
        cell, angle = np.full(len(vec), ZEROS), np.zeros(len(vec))
        for a in attr.unique():
            own = np.flatnonzero(attr.to_numpy() == a)
            vectors = np.stack(vec.to_numpy()[own]).astype(float)
            own, vectors = own[vectors.any(axis=1)], vectors[vectors.any(axis=1)]
            for i in range(0, len(own), 256):
                angles = pivots[a].angles(vectors[i : i + 256])
                cell[own[i : i + 256]], angle[own[i : i + 256]] = angles.argmin(axis=1), angles.min(axis=1)
        return pd.DataFrame({"cell": cell, "angle": angle})

    v = vector_column("value")
    q = asked.select(F.to_json(F.struct("attr", "value")).alias("qid"), "attr", "value", F.col("vec").alias(v), F.lit(k).cast("long").alias("_need"))
    if all(len(p.vectors) == 1 for p in pivots.values()):  # one cell an attribute: nothing to leave out
        one = values.select(F.col("value").alias("cid"), "attr", "value", F.col("vec").alias(v))
        return _by_value(_best(_compared(q, one, ["attr"], ["value"], None, 0, exclude_equal, False, [])))
    in_cells = cut(values.withColumn("_p", placed("attr", "vec")).select("attr", "value", "vec", F.col("_p.cell").alias("_cell"), "_p.angle"))
    rings = in_cells.groupBy("attr", "_cell").agg(F.min("angle").alias("low"), F.max("angle").alias("high"), F.count(F.lit(1)).alias("n"))
    for r in rings.collect():  # a row for each pivot
        if r["_cell"] == ZEROS:
            pivots.setdefault(r.attr, _Pivots(np.zeros((0, 1)))).zeros = r.n
        else:
            p = pivots[r.attr]
            p.least[r["_cell"]], p.greatest[r["_cell"]], p.n[r["_cell"]] = r.low - _MARGIN, r.high + _MARGIN, r.n

    wanted = k + exclude_equal

    def first_cells(p: _Pivots, bounds: np.ndarray) -> list[int]:
        order = np.argsort(bounds, kind="stable")
        enough = int(np.searchsorted(np.cumsum(p.n[order]) + p.zeros, wanted)) + 1
        return [int(x) for x in order[:enough] if bounds[x] < np.inf] + [ZEROS] * (p.zeros > 0)

    @F.pandas_udf("array<int>")
    def cells_at_first(attr: pd.Series, vec: pd.Series) -> pd.Series:
        known = [pivots.get(a) for a in attr]
        return pd.Series([first_cells(p, p.bounds(np.asarray(x, float))) if p else [] for p, x in zip(known, vec)], dtype=object)

    @F.pandas_udf("array<int>")
    def cells_left(attr: pd.Series, vec: pd.Series, worst: pd.Series) -> pd.Series:
        out = []
        for a, x, d in zip(attr, vec, worst):
            if a not in pivots:
                out.append([])
                continue
            bounds = pivots[a].bounds(np.asarray(x, float))
            reach = np.inf if np.isnan(d) else np.arccos(np.clip(1.0 - d, -1.0, 1.0)) + _MARGIN
            done = set(first_cells(pivots[a], bounds))
            out.append([int(i) for i in np.flatnonzero((bounds <= reach) & (bounds < np.inf)) if i not in done])
        return pd.Series(out, dtype=object)

    c = in_cells.select(F.col("value").alias("cid"), "attr", "value", F.col("vec").alias(v), "_cell")
    how = (["attr", "_cell"], ["value"], None, 0, exclude_equal, False, [])
    near = cut(_best(_compared(q.withColumn("_cell", F.explode(cells_at_first("attr", v))), c, *how)).drop("rank"))
    worst = near.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("_worst"))
    more = q.join(worst, "qid", "left").withColumn("_cell", F.explode(cells_left("attr", v, F.col("_worst"))))
    return _by_value(_best(near.unionByName(_compared(more.drop("_worst"), c, *how))))


def _by_value(found: DataFrame) -> DataFrame:
    key = F.from_json("qid", "attr string, value string")
    return found.select(key["attr"].alias("attr"), key["value"].alias("value"), F.col("cid").alias("neighbour"), "dist", "rank")


def value_neighbours(values: DataFrame, k: int, sources: DataFrame | None = None) -> DataFrame:
    """k nearest other values of the same attribute: ``attr, value, neighbour, dist, rank``.

    ``values`` is (attr, value, vec); ``sources`` may restrict whose neighbours are wanted.
    """
    side = values.select("attr", "value", "vec")
    asked = side if sources is None else side.join(sources.select("attr", "value").distinct(), ["attr", "value"])
    return nearest_values(asked, side, k, exclude_equal=True)
