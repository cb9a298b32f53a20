"""Near-duplicate documents by SetSketch registers.

1. A text's set of word shingles is sketched: register ``i`` is the truncated level, on an exponential
   scale of base ``B``, of the least value that hash ``i`` gives any element, as an exponential variable
   of rate ``RATE``. Registers of a union are the greater ones, so sketches merge; equal registers are
   about as likely as the sets are similar.
2. Documents with equal sets become one class, represented by its least doc_id.
3. Bands of registers are hashed to buckets. In every bucket all classes are paired with one (the hub), so a
   bucket of g classes gives g - 1 pairs. The hub is chosen by a hash of class and bucket, so members of
   a large group are paired with other hubs in other bands and soon hang together.
4. For each pair, bitmaps of both sets first bound their difference from below; a pair whose bound is
   too large is no link for certain. Then the similarity is estimated by maximum likelihood, jointly from
   the counts of smaller, equal and greater registers and both set sizes. Pairs far below the threshold
   are dropped (six standard errors), the others are verified on the full sets of shingles.
5. Links so far give components. A link between two classes that met in a bucket, and is not known yet,
   can only join two components. Buckets that still hold several components, and more than two
   classes, are cut into blocks; pairs of blocks compare their sketches side by side in a task and
   emit only pairs across components whose estimate passes. These are verified likewise.

With ``BANDS`` of ``BAND_ROWS`` registers, two sets of similarity 0.8 share no bucket with a chance of
below 1e-6. Results do not depend on the size of the table or of a bucket.

Defined cases: a null text counts as empty; a document without words has an empty set and is linked
with nothing; rows with a null doc_id are linked with nothing, have no component and are kept; rows that
share a doc_id are one document, linked by any of its texts; an empty table gives no rows; further columns
pass through ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from cpdspark.functions.lineage import cut
from cpdspark.llm.components import components
from cpdspark.llm.names import fresh, others
from cpdspark.llm.text_arrays import Block, blocks, mixed, slices

BANDS, BAND_ROWS = 48, 6
REGISTERS = BANDS * BAND_ROWS
B, RATE, TOP = 1.001, 20.0, 65_535
PERCENT = 80  # least similarity of linked sets
ERRORS = 6.0  # standard errors that an estimate may fall short
BLOCK = 2048  # classes of a bucket compared at a time; a block is fetched once for each other block of its bucket
BITS = 4096  # of the bitmap of a set
BROADCAST_IDS = 1_000_000  # 8 MB; beyond it the join shuffles

_rng = np.random.Generator(np.random.PCG64(20_240_601))
_LOW, _HIGH = (_rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32) | np.uint32(1) for _ in range(2))


def shingle_hashes(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Distinct 64-bit hashes of the shingles of each text."""
    out = []
    for run in blocks(texts):
        b = Block(run)
        starts, ends = b.words()
        word, text = b.hashes(starts, ends), b.text_of(starts)
        first = np.searchsorted(text, np.arange(b.n + 1))
        rolled = word.copy()
        for k in range(1, width):
            rolled[: max(0, len(word) - k)] = mixed(rolled[: max(0, len(word) - k)] * np.uint64(3) + word[k:])
        for lo, hi in zip(first[:-1], first[1:]):
            if hi - lo >= width:
                out.append(np.unique(rolled[lo : hi - width + 1]))
            elif hi > lo:
                h = word[lo : lo + 1] + np.uint64(hi - lo)
                for k in range(lo + 1, hi):
                    h = mixed(h * np.uint64(5) + word[k])
                out.append(h)
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def registers(hashes: np.ndarray) -> np.ndarray:
    """The sketch of a set; all zero for an empty one."""
    if not len(hashes):
        return np.zeros(REGISTERS, np.uint16)
    low, high = hashes.astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(hashes), 2048):
        values = np.multiply.outer(_LOW, low[i : i + 2048])
        values += np.multiply.outer(_HIGH, high[i : i + 2048])
        np.minimum(least, values.min(axis=1), out=least)
    x = -np.log1p(-(least.astype(np.float64) + 0.5) / 2**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(B)), 0, TOP).astype(np.uint16)


def bitmap(hashes: np.ndarray) -> np.ndarray:
    """Which of ``BITS`` slots the elements hash to, packed."""
    slots = np.zeros(BITS, bool)
    slots[(mixed(hashes) >> np.uint64(40)).astype(np.int64) % BITS] = True
    return np.packbits(slots)


def may_link(bits_a: np.ndarray, bits_b: np.ndarray, size_a, size_b, percent: int) -> np.ndarray:
    """False where the sets differ too much for certain: every slot that one of them has is an element of
    their difference, and similar sets differ in at most (1 - s) / (1 + s) of their sizes together."""
    differ = np.bitwise_count(bits_a ^ bits_b).sum(-1, dtype=np.int64)
    return differ * (100 + percent) <= (np.asarray(size_a) + np.asarray(size_b)) * (100 - percent)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union."""
    return np.maximum(a, b)


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (B - 1) / B) / np.log(B)


def estimate(less, equal, greater, size_a, size_b) -> np.ndarray:
    """Most likely Jaccard similarity, from how many registers of a are less, equal, greater than b's."""
    less, equal, greater = (np.asarray(v, float) for v in (less, equal, greater))
    u = np.asarray(size_a, float) / (np.asarray(size_a, float) + np.asarray(size_b, float))
    v = 1 - u
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = _p(np.maximum(u - v * j, 0)), _p(np.maximum(v - u * j, 0))
        log = lambda p: np.log(np.maximum(p, 1e-300))
        return greater * log(up) + less * log(down) + equal * log(1 - up - down)

    for _ in range(40):  # the likelihood is concave
        a, b = low + (high - low) / 3, high - (high - low) / 3
        left = likelihood(a) < likelihood(b)
        low, high = np.where(left, a, low), np.where(left, high, b)
    return (low + high) / 2


def least_estimate(percent: int = PERCENT) -> float:
    s = percent / 100
    return s - ERRORS * float(np.sqrt(s * (1 - s) / REGISTERS))


def band_keys(sketches: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for every row and band."""
    parts = sketches.reshape(len(sketches), BANDS, BAND_ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(1), (len(sketches), BANDS)).copy()
    for k in range(BAND_ROWS):
        key = mixed(key * np.uint64(0x100000001B3) + parts[:, :, k])
    return key.view(np.int64)


def _sketched(documents: DataFrame, width: int) -> DataFrame:
    """``doc_id, n, set_id, sketch`` for every row; ``sketch`` is the registers and the bitmap."""

    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, (part, texts) in ((b, x) for b in batches for x in slices(b.text)):
            sets = shingle_hashes(texts, width)
            identity = [
                np.array([s.sum(dtype=np.uint64), mixed(s).sum(dtype=np.uint64)]).tobytes() if len(s) else None for s in sets
            ]
            sketches = [registers(s).tobytes() + bitmap(s).tobytes() for s in sets]
            ids = b.doc_id.to_numpy()[part]
            yield pd.DataFrame({"doc_id": ids, "n": [len(s) for s in sets], "set_id": identity, "sketch": sketches})

    return documents.select("doc_id", "text").mapInPandas(sketch, "doc_id long, n long, set_id binary, sketch binary")


def _full_sets(documents: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``id, n, elements`` of the documents that ``ids`` names."""

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b, (part, texts) in ((b, x) for b in batches for x in slices(b.text)):
            sets = shingle_hashes(texts, width)
            yield pd.DataFrame({"id": b.doc_id.to_numpy()[part], "elements": [s.view(np.int64) for s in sets]})

    ids = cut(ids)
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    named = documents.select("doc_id", "text").join(few, documents["doc_id"] == few["id"], "left_semi")
    return cut(named.mapInPandas(shingles, "id long, elements array<long>"))


def _parts(sketches) -> tuple[np.ndarray, np.ndarray]:
    """Registers and bitmaps, a row for each sketch."""
    raw = np.frombuffer(b"".join(map(bytes, sketches)), np.uint8).reshape(len(sketches), 2 * REGISTERS + BITS // 8)
    return np.ascontiguousarray(raw[:, : 2 * REGISTERS]).view(np.uint16), raw[:, 2 * REGISTERS :].copy()


@F.pandas_udf(T.ArrayType(T.LongType()))
def _buckets(sketches: pd.Series) -> pd.Series:
    return pd.Series(list(band_keys(_parts(list(sketches))[0])), dtype=object)


def _passing(x, x_bits, n, y, y_bits, m, percent: int) -> np.ndarray:
    """Which pairs of rows may be links, by bitmaps and then by estimate."""
    ok = may_link(x_bits, y_bits, n, m, percent)
    k = np.flatnonzero(ok)
    if len(k):
        x, y = x[k], y[k]
        j = estimate((x < y).sum(1), (x == y).sum(1), (x > y).sum(1), np.asarray(n)[k], np.asarray(m)[k])
        ok[k] = j >= least_estimate(percent)
    return ok


@F.pandas_udf(T.BooleanType())
def _pair_passes(a: pd.Series, b: pd.Series, n: pd.Series, m: pd.Series, percent: pd.Series) -> pd.Series:
    if not len(a):
        return pd.Series([], dtype=bool)
    (x, x_bits), (y, y_bits) = _parts(list(a)), _parts(list(b))
    return pd.Series(_passing(x, x_bits, n.to_numpy(), y, y_bits, m.to_numpy(), int(percent.iloc[0])))


def _alike_sizes(n: str, m: str, percent: int):
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def _likely(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sizes and estimate allow a link."""
    left = classes.select(F.col("rep").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = classes.select(F.col("rep").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    both = pairs.join(left, "a").join(right, "b").filter(_alike_sizes("n_a", "n_b", percent))
    return both.filter(_pair_passes("s_a", "s_b", "n_a", "n_b", F.lit(percent))).select("a", "b")


def _verified(pairs: DataFrame, documents: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs that are links, judged on full sets."""
    pairs = cut(pairs)
    ids = pairs.select(F.col("a").alias("id")).distinct().unionByName(pairs.select(F.col("b").alias("id")).distinct()).distinct()
    sets = _full_sets(documents, ids, width)
    left = sets.select(F.col("id").alias("a"), F.col("elements").alias("e_a"))
    right = sets.select(F.col("id").alias("b"), F.col("elements").alias("e_b"))
    both = F.size(F.array_intersect("e_a", "e_b"))
    linked = pairs.join(left, "a").join(right, "b").withColumn("both", both)
    return linked.filter(F.col("both") * 100 >= (F.size("e_a") + F.size("e_b") - F.col("both")) * percent).select("a", "b")


def _across(members: DataFrame, percent: int) -> DataFrame:
    """Likely pairs across components within buckets: ``members`` has key, g, rep, part, n, sketch.

    The members of a bucket of g classes are dealt into ``g / BLOCK`` blocks by a hash. Only the numbers of
    blocks are paired by bucket; each pair then fetches its two blocks, so a hot bucket is many tasks.
    """
    ends = F.min("part").alias("low"), F.max("part").alias("high")
    rows = F.collect_list(F.struct("rep", "part", "n", "sketch")).alias("rows")
    within = members.filter(F.col("g") <= BLOCK).groupBy("key").agg(rows, *ends).filter("low != high").select("rows")
    block = F.pmod(F.xxhash64("rep"), F.ceil(F.col("g") / BLOCK)).cast("int")
    held = members.filter(F.col("g") > BLOCK).withColumn("block", block).groupBy("key", "block").agg(rows, *ends)
    known = held.select("key", "block", "low", "high")
    other = known.select("key", *[F.col(c).alias(f"{c}2") for c in ("block", "low", "high")])
    several = (F.col("low") != F.col("high")) | (F.col("low2") != F.col("high2")) | (F.col("low") != F.col("low2"))
    pairs = known.join(other, "key").filter((F.col("block") <= F.col("block2")) & several).select("key", "block", "block2")
    met = pairs.join(held.select("key", "block", "rows"), ["key", "block"])
    met = met.join(held.select("key", F.col("block").alias("block2"), F.col("rows").alias("rows2")), ["key", "block2"])
    met = within.withColumn("rows2", F.lit(None).cast(within.schema["rows"].dataType)).unionByName(met.select("rows", "rows2"))

    def arrays(rows) -> tuple:
        return (*(np.array([r[c] for r in rows]) for c in ("rep", "part", "n")), *_parts([r["sketch"] for r in rows]))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for one, two in zip(batch.rows, batch.rows2):
                rep, part, n, x, x_bits = arrays(one)
                rep2, part2, n2, y, y_bits = arrays(one if two is None else two)  # a block by itself
                first, second = [], []
                for i in range(len(rep)):
                    other = np.flatnonzero((part2 != part[i]) & (np.minimum(n2, n[i]) * 100 >= np.maximum(n2, n[i]) * percent))
                    other = other[may_link(x_bits[i], y_bits[other], n[i], n2[other], percent)]
                    first.append(np.full(len(other), i))
                    second.append(other)
                i, k = np.concatenate(first), np.concatenate(second)
                for at in range(0, len(i), 4096):
                    a, b = i[at : at + 4096], k[at : at + 4096]
                    ok = _passing(x[a], x_bits[a], n[a], y[b], y_bits[b], n2[b], percent)
                    if ok.any():
                        pairs = np.column_stack([rep[a[ok]], rep2[b[ok]]])
                        yield pd.DataFrame({"a": pairs.min(1), "b": pairs.max(1)})

    return met.select("rows", "rows2").mapInPandas(compare, "a long, b long").distinct()


def cluster(documents: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """One row per row with an id: ``doc_id, n_shingles, component_id``."""
    known = documents.select("doc_id", "text").dropna(subset=["doc_id"])
    sketched = cut(_sketched(known, width))
    with_words = sketched.filter("n > 0")
    classes = cut(with_words.groupBy("set_id", "n").agg(F.min("doc_id").alias("rep"), F.first("sketch").alias("sketch")))

    banded = classes.select("rep", F.explode(_buckets("sketch")).alias("key"))
    chosen = F.min_by("rep", F.xxhash64("rep", "key"))
    buckets = banded.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("last"), chosen.alias("hub"), F.count("*").alias("g"))
    shared = buckets.filter("low != last").select("key", "hub", "g")
    met = cut(banded.join(shared, "key"))
    hubs = met.filter("rep != hub").select(F.least("hub", "rep").alias("a"), F.greatest("hub", "rep").alias("b")).distinct()
    links = _verified(_likely(hubs, classes, percent), known, width, percent)

    rep_of = sketched.join(classes.select("set_id", "n", "rep"), ["set_id", "n"])
    # a doc_id with several texts joins their classes
    twice = rep_of.groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a")).filter("a != b")
    same = twice.join(rep_of.select("doc_id", "rep"), "doc_id").select(F.col("rep").alias("a"), "b")
    stars = components(links.unionByName(same))

    part = stars.select(F.col("a").alias("rep"), F.col("b").alias("part"))
    placed = met.filter("g > 2 and rep != hub").join(part, "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    open_keys = placed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high")).filter("low != high")
    members = placed.join(open_keys.select("key"), "key").select("key", "g", "rep", "part")
    members = members.join(classes.select("rep", "n", "sketch"), "rep")
    more = _verified(_across(members, percent), known, width, percent)
    final = components(stars.unionByName(more))

    labelled = rep_of.select("doc_id", "rep").join(final.select(F.col("a").alias("rep"), "b"), "rep", "left")
    of_row = labelled.groupBy("doc_id").agg(F.min(F.coalesce("b", "rep")).alias("component_id"))
    return sketched.select("doc_id", F.col("n").alias("n_shingles")).join(of_row, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def report(documents: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row; rows without an id at the end."""
    nameless = _sketched(documents.filter("doc_id is null"), width)
    alone = nameless.select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id"))
    return cluster(documents, width, percent).unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def deduplicate(documents: DataFrame, width: int = 5, percent: int = PERCENT) -> DataFrame:
    """The documents without near copies: of each component the least doc_id stays, as one row.

    Rows that repeat that doc_id are the same document; the one whose text has the least SHA-256 stands for it,
    and among equal texts the one of least hash over its other columns (maps left out).
    """
    columns, own = others(documents.columns), fresh(documents.columns, "_kept")
    least = cluster(documents, width, percent).filter("doc_id = component_id").select(F.col("doc_id").alias(own)).distinct()
    plain = [F.col(f"`{f.name}`") for f in documents.schema if "map<" not in f.dataType.simpleString()]
    order = F.struct(F.sha2("text", 256), F.xxhash64(*plain))
    stay = documents.join(least, documents["doc_id"] == least[own])
    one = stay.groupBy(own).agg(F.min_by(F.struct(*columns), order).alias("row")).select("row.*")
    return one.unionByName(documents.filter("doc_id is null"))
