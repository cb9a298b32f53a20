"""Toxicity by a classifier chain.

The categories are predicted one after the other; the model of each also gets the probabilities of
the categories before it. So that training sees these as scoring will, they are out-of-fold: each row's
probability comes from a model fitted without that row's fold. Every model is linear, over the presence
of words and of their beginnings (4 and 6 bytes, so inflected forms share them), hashed, and the earlier
probabilities; the terms with the strongest chi-square in the rows a model is fitted on are its features.

Fitting uses ``sample`` labelled rows at most in expectation (a documented bound, chosen by a hash of the
id, so the same rows in every run); their sets of hashed terms go to one task. Scoring reads each text
once, in blocks, without a shuffle; a block looks up all its terms and keeps only the chosen ones.

Defined cases: a null text counts as empty and gets the probabilities of a text without known terms;
labels with a null id or a null in a category are not used; labels that share an id count as one row, with
the greater value of each category; a category of which the sample has one value only gets that value's
share, shrunk towards a half by one row of either value; null ids, repeated rows and further columns
of the documents pass through, but for columns named like a result, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cpdspark.llm import linear
from cpdspark.llm.names import fresh, others
from cpdspark.llm.text_arrays import BLOCK_BYTES, Block, blocks, mixed, slices

SAMPLE = 12_000
BEGINNINGS, BITS = (4, 6), 20
FEATURES = 1_024
LEAST_ROWS = 3  # of the sample that have a feature
FOLDS = 4
L2 = 0.1
THRESHOLD = 0.5


@dataclass(frozen=True)
class Link:
    """The model of one category: slots of its terms, their weights, those of earlier probabilities, a constant."""

    category: str
    slots: np.ndarray
    weights: np.ndarray
    earlier: np.ndarray
    constant: float


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows whose labels may be learnt; the others are held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) != 1


_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _terms(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Texts and slots of all words and beginnings of words (runs of letters and digits)."""
    starts, ends = block.runs(_IN_WORD)
    text = block.text_of(starts)
    texts, hashes = [text], [block.hashes(starts, ends)]
    for n in BEGINNINGS:
        longer = ends - starts > n
        hashes.append(mixed(block.hashes(starts[longer], starts[longer] + n) + np.uint64(n)))
        texts.append(text[longer])
    return np.concatenate(texts), (np.concatenate(hashes) >> np.uint64(64 - BITS)).astype(np.int64)


def _term_sets(documents: DataFrame) -> DataFrame:
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part, run in slices(b.text):
                block = Block(run)
                text, slot = _terms(block)
                pair = np.unique((text << BITS) + slot)
                sets = np.split((pair & ((1 << BITS) - 1)).astype("<i4"), np.searchsorted(pair >> BITS, np.arange(1, block.n)))
                yield pd.DataFrame({"doc_id": b.doc_id.to_numpy()[part], "terms": [x.tobytes() for x in sets]})

    return documents.select("doc_id", "text").mapInPandas(sets, "doc_id long, terms binary")


def _chosen(x: linear.Rows, y: np.ndarray, most: int) -> np.ndarray:
    """The sparse features with the greatest chi-square."""
    n, positive = len(y), y.sum()
    with_feature = np.bincount(x.feature, minlength=x.d).astype(float)
    both = np.bincount(x.feature[(y > 0)[x.row]], minlength=x.d).astype(float)
    expected = with_feature * positive / n
    spread = expected * (1 - positive / n) * (1 - with_feature / n)
    chi2 = np.where((with_feature >= LEAST_ROWS) & (spread > 0), (both - expected) ** 2 / np.maximum(spread, 1e-9), 0)
    best = np.argsort(-chi2, kind="stable")[:most]
    return np.sort(best[chi2[best] > 0])


def _fit_link(x: linear.Rows, y: np.ndarray, features: int, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """Chosen features; weights for them and for the dense part."""
    if y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        w = np.zeros(x.dense.shape[1])
        w[-1] = np.log(share / (1 - share))
        return np.zeros(0, np.int64), w
    chosen = _chosen(x, y, features)
    return chosen, linear.fit(_renumbered(x, chosen), y, l2)


def _renumbered(x: linear.Rows, chosen: np.ndarray) -> linear.Rows:
    number = np.full(x.d, -1, np.int32)
    number[chosen] = np.arange(len(chosen))
    known = number[x.feature] >= 0
    return linear.Rows(x.row[known], number[x.feature[known]], x.n, len(chosen), x.dense)


def fit_chain(terms: list[bytes], labels: np.ndarray, folds: np.ndarray, categories: list[str], features: int, l2: float) -> list[Link]:
    """Fit all links on a sample of rows; ``labels`` has a column for each category."""
    sets = [np.frombuffer(g, "<i4") for g in terms]
    row = np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
    feature = np.concatenate([*sets, np.zeros(0, "<i4")])
    common = (np.bincount(feature, minlength=1 << BITS) >= LEAST_ROWS)[feature]  # no model takes the others
    row, feature = row[common], feature[common]
    earlier = np.zeros((len(sets), 0))
    links = []
    for k, category in enumerate(categories):
        y = labels[:, k].astype(float)
        x = linear.Rows(row, feature, len(sets), 1 << BITS, np.hstack([earlier, np.ones((len(sets), 1))]))
        chosen, w = _fit_link(x, y, features, l2)
        links.append(Link(category, chosen, w[: len(chosen)], w[len(chosen) : -1], float(w[-1])))
        if k + 1 < len(categories):
            held = np.zeros(len(sets))
            for f in np.unique(folds):
                test = folds == f
                if test.all():
                    held[test] = y.mean()
                    continue
                own, v = _fit_link(x.only(~test), y[~test], features, l2)
                held[test] = linear.sigmoid(_renumbered(x.only(test), own).times(v))
            earlier = np.hstack([earlier, held[:, None]])
    return links


_LINK = "k int, category string, slots binary, weights binary, earlier binary, constant double"


def fit(
    documents: DataFrame,
    labels: DataFrame,
    categories: list[str],
    sample: int = SAMPLE,
    features: int = FEATURES,
    folds: int = FOLDS,
    l2: float = L2,
) -> list[Link]:
    """Fit on learnable labelled documents; ``labels`` has doc_id and a 0/1 column for each category."""
    known = labels.filter(learnable()).dropna(subset=["doc_id", *categories])
    known = known.groupBy("doc_id").agg(*[F.max(c).cast("double").alias(c) for c in categories])
    share = min(1.0, sample / max(1, known.count()))
    known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    chosen = documents.select("doc_id", "text").join(F.broadcast(known.select("doc_id")), "doc_id", "left_semi")
    rows = _term_sets(chosen).join(F.broadcast(known), "doc_id")
    rows = rows.withColumn("fold", F.pmod(F.xxhash64(F.lit("fold"), "doc_id"), F.lit(folds)))

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "terms"], ignore_index=True)
        chain = fit_chain(list(frame.terms), frame[categories].to_numpy(), frame.fold.to_numpy(), categories, features, l2)
        raw = lambda a: a.astype("<f8").tobytes()
        return pd.DataFrame(
            [(k, c.category, c.slots.astype("<i8").tobytes(), raw(c.weights), raw(c.earlier), c.constant) for k, c in enumerate(chain)],
            columns=["k", "category", "slots", "weights", "earlier", "constant"],
        )

    fitted = sorted(rows.groupBy(F.lit(0).alias("all")).applyInPandas(train, _LINK).collect(), key=lambda r: r.k)
    if not fitted:  # no labelled row at all
        return [Link(c, np.zeros(0, np.int64), np.zeros(0), np.zeros(k), 0.0) for k, c in enumerate(categories)]
    numbers = lambda b, kind="<f8": np.frombuffer(bytes(b), kind)
    return [Link(r.category, numbers(r.slots, "<i8"), numbers(r.weights), numbers(r.earlier), r.constant) for r in fitted]


def score_texts(texts: list[bytes], chain: list[Link]) -> np.ndarray:
    """Probabilities, a row for each text and a column for each category."""
    slots = np.unique(np.concatenate([c.slots for c in chain]))
    number = np.full(1 << BITS, -1, np.int32)
    number[slots] = np.arange(len(slots))
    weights = np.zeros((len(chain), len(slots)))
    for k, c in enumerate(chain):
        weights[k, number[c.slots]] = c.weights
    out = []
    for run in blocks(texts):
        block = Block(run)
        text, slot = _terms(block)
        found = number[slot]
        known = found >= 0
        pair = np.unique(text[known] * len(slots) + found[known])
        text, feature = np.divmod(pair, max(1, len(slots)))
        p = np.zeros((block.n, len(chain)))
        for k, c in enumerate(chain):
            z = np.bincount(text, weights[k, feature], minlength=block.n) + c.constant
            p[:, k] = linear.sigmoid(z + p[:, : len(c.earlier)] @ c.earlier)
        out.append(p)
    return np.vstack([*out, np.zeros((0, len(chain)))])


def score(documents: DataFrame, chain: list[Link]) -> DataFrame:
    """All columns and ``p_<category>`` for each link."""
    names = [f"p_{c.category}" for c in chain]
    sent = documents.sparkSession.sparkContext.broadcast(chain)  # FEATURES numbers for each category

    @F.pandas_udf(f"struct<{', '.join(f'{n}:double' for n in names)}>")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            for _, run in slices(texts, 8 * BLOCK_BYTES):
                yield pd.DataFrame(score_texts(run, sent.value), columns=names)

    columns, own = others(documents.columns, *names), fresh(documents.columns, "_p")
    out = documents.select(*columns, scored("text").alias(own))
    return out.select(*columns, *[F.col(f"`{own}`")[n].alias(n) for n in names])
