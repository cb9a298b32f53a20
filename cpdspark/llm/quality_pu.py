"""Text quality learnt from trusted positives and unlabelled web text.

Only rows labelled good are trusted; all other text is unlabelled, a mixture of good and bad with an
unknown share of good ones (the class prior).

1. A first model separates positives from unlabelled texts. On the part of the sample that it was not
   fitted on, the prior is the least ratio, over score thresholds, of the share of unlabelled texts
   above the threshold to the share of positives above it, with a margin for the sample's size: what is
   above contains at least ``prior * positives above`` of the unlabelled, and a good threshold contains
   little else.
2. The second model minimises the non-negative unbiased risk: ``prior * R+(positives) +
   max(-slack, R-(unlabelled) - prior * R-(positives))``. Where the second part falls below the slack,
   the step goes the other way, so the model cannot win by driving it below zero.

Features are figures of a text (repetition, capitals, symbols, marks, lengths, lines), each cut at
quantiles of the sample; the model is linear over these steps. Neither labels, lang, source nor doc_id
is an input of a score.

Fitting uses ``sample`` positives and as many unlabelled texts at most in expectation (a documented bound;
rows are chosen by a hash of the id). Scoring is one pass without a shuffle.

Defined cases: null and empty texts have the same figures, all 0, and get the score of these; without
any positive the score is 0.5 for all; null ids, repeated rows and further columns pass through
``score``; labels with a null are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cpdspark.llm.linear import descend, sigmoid
from cpdspark.llm.text_arrays import Block, as_bytes, blocks
from cpdspark.llm.toxicity import learnable

SAMPLE = 10_000
STEPS = 12  # quantiles of a feature
SLACK = 0.0
L2 = 0.002
FEATURES = (
    "log_words word_length longest_word distinct_words same_as_before repeated_share capitals capital_words digits symbols "
    "marks doubled_marks sentence_marks bars line_length distinct_lines non_ascii short_words"
).split()

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _among(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_SYMBOL, _MARK, _STOP, _BAR = _among(b"#*$%&<>~^=@\\{}[]"), _among(b"!?.,;:"), _among(b".!?"), _among(b"|")


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def _distinct(text: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and the count of its most frequent value."""
    if not len(text):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((value, text))
    t, v = text[order], value[order]
    new = np.concatenate([[True], (t[1:] != t[:-1]) | (v[1:] != v[:-1])])
    runs = np.diff(np.append(np.flatnonzero(new), len(t)))
    most = np.zeros(n)
    np.maximum.at(most, t[new], runs)
    return np.bincount(t[new], minlength=n), most


def figures(texts: list[bytes]) -> np.ndarray:
    """One row for each text, one column for each of ``FEATURES``."""
    out = []
    for run in blocks(texts):
        b = Block(run, lower=False)
        n, data = b.n, b.data
        starts, ends = b.words()
        text = b.text_of(starts)
        words = np.bincount(text, minlength=n).astype(float)
        length = ends - starts
        hashes = b.hashes(starts, ends)
        distinct, most = _distinct(text, hashes, n)
        same = np.zeros(len(text), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (text[1:] == text[:-1])
        upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
        capital = (upper[ends] - upper[starts] >= 2) if len(text) else same
        longest = np.zeros(n)
        np.maximum.at(longest, text, length)
        size = np.maximum(b.sizes, 1)
        marks = _MARK[data]
        doubled = marks.copy()
        doubled[1:] &= data[1:] == data[:-1]
        doubled[:1] = False
        at = np.flatnonzero(data == 10)
        edges = np.sort(np.concatenate([b.starts[:-1], at + 1]))
        last = np.minimum(np.append(edges[1:] - 1, len(data)), b.starts[b.text_of(edges) + 1])
        last = np.maximum(last, edges)
        line_text = b.text_of(edges)
        lines = np.bincount(line_text, minlength=n).astype(float)
        distinct_lines, _ = _distinct(line_text, b.hashes(edges, last), n)
        letters = np.bincount(text, length, minlength=n)
        columns = [
            np.log1p(words),
            _ratio(letters, words),
            longest,
            _ratio(distinct, words ** 0.9),
            _ratio(np.bincount(text, same, minlength=n), words),
            _ratio(most, words),
            b.counts(_UPPER[data]) / size,
            _ratio(np.bincount(text, capital, minlength=n), words),
            b.counts(_DIGIT[data]) / size,
            _ratio(b.counts(_SYMBOL[data]), words),
            _ratio(b.counts(marks), words),
            _ratio(b.counts(doubled), words),
            _ratio(b.counts(_STOP[data]), words),
            _ratio(b.counts(_BAR[data]), words),
            _ratio(words, lines),
            _ratio(distinct_lines, lines),
            b.counts(data >= 128) / size,
            _ratio(np.bincount(text, length <= 3, minlength=n), words),
        ]
        out.append(np.column_stack(columns))
    return np.vstack([*out, np.zeros((0, len(FEATURES)))])


@dataclass(frozen=True)
class Model:
    borders: list[np.ndarray]  # of each feature
    weights: np.ndarray  # one for each step, then a constant
    prior: float


def _steps(x: np.ndarray, borders: list[np.ndarray]) -> np.ndarray:
    """Indicators that a feature lies above each of its borders, and a constant."""
    above = [x[:, [k]] > b for k, b in enumerate(borders)]
    return np.hstack([*above, np.ones((len(x), 1))]).astype(float)


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    return descend(lambda w: x.T @ (weight * (sigmoid(x @ w) - y)) + L2 / 20 * w, np.zeros(x.shape[1]), 300, 0.05)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Least ratio of the shares above a threshold, with a margin; of scores on rows not fitted on."""
    thresholds = np.unique(np.quantile(positive, np.linspace(0, 0.9, 91)))
    p = np.array([(positive >= t).mean() for t in thresholds])
    u = np.array([(unlabelled >= t).mean() for t in thresholds])
    margin = 1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled))
    best = np.argmin(u / p + margin / p)
    return float(np.clip(u[best] / p[best], 0.01, 0.99))


def fit_pu(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    """Both steps on the figures of a sample."""
    everything = np.vstack([positive, unlabelled])
    borders = []
    for k in range(everything.shape[1]):
        values = np.unique(np.quantile(everything[:, k], np.linspace(0, 1, STEPS + 1)[:-1]))
        tail = np.quantile(everything[:, k], [0.01, 0.03, 0.95, 0.97, 0.99])
        borders.append(np.unique(np.concatenate([values, tail])))
    p, u = _steps(positive, borders), _steps(unlabelled, borders)
    fitted = lambda rows: np.arange(len(rows)) % 2 == 0
    half_p, half_u = fitted(p), fitted(u)
    if half_p.all() or half_u.all():
        prior, first = 0.5, np.zeros(p.shape[1])
    else:
        x = np.vstack([p[half_p], u[half_u]])
        first = _logistic(x, np.concatenate([np.ones(half_p.sum()), np.zeros(half_u.sum())]))
        prior = estimate_prior(p[~half_p] @ first, u[~half_u] @ first)

    # the sigmoid loss is bounded, so a small error of the prior stays a small error of the risk
    def gradient(w: np.ndarray) -> np.ndarray:
        sp, su = sigmoid(p @ w), sigmoid(u @ w)
        good = prior * (p.T @ (sp * (sp - 1))) / len(p)  # of the loss of calling positives bad
        bad = u.T @ (su * (1 - su)) / len(u) - prior * (p.T @ (sp * (1 - sp))) / len(p)  # of calling the rest good
        penalty = L2 / 20 * w
        penalty[-1] = 0
        return (good + bad if su.mean() - prior * sp.mean() >= -SLACK else -bad) + penalty

    start = 3 * first
    start[-1] += 3 * np.log(2 * prior)  # where the first model's odds and the prior make good and bad equal
    return Model(borders, descend(gradient, start, 400, 0.02), prior)


def score_texts(texts: list[bytes], model: Model) -> np.ndarray:
    if not len(model.weights):
        return np.full(len(texts), 0.5)
    x = figures(texts)
    return np.concatenate(
        [sigmoid(_steps(x[i : i + 4096], model.borders) @ model.weights) for i in range(0, len(x), 4096)] + [np.zeros(0)]
    )


def fit(documents: DataFrame, labels: DataFrame, good: str = "quality", sample: int = SAMPLE) -> Model:
    """Trusted positives are the learnable rows of ``labels`` with ``good`` = 1; all documents are unlabelled."""
    trusted = labels.filter(learnable()).filter(F.col(good) == 1).select("doc_id").dropna().distinct()
    of = lambda n: int(min(1.0, sample / max(1, n)) * (1 << 30))
    trusted = trusted.filter(F.pmod(F.xxhash64(F.lit("p"), "doc_id"), F.lit(1 << 30)) < of(trusted.count()))
    positive = documents.select("doc_id", "text").join(F.broadcast(trusted), "doc_id", "left_semi")
    # by id and text, so that rows without an id, or of one id, are drawn one by one; rows equal in both count once
    chance = F.pmod(F.xxhash64(F.lit("u"), "doc_id", "text"), F.lit(1 << 30))
    unlabelled = documents.select("doc_id", "text").filter(chance < of(documents.count())).distinct()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = figures([as_bytes(t) for t in b.text])
            yield pd.DataFrame({"doc_id": b.doc_id, "trusted": b.trusted, "x": [r.tobytes() for r in rows]})

    both = positive.withColumn("trusted", F.lit(True)).unionByName(unlabelled.withColumn("trusted", F.lit(False)))
    rows = both.mapInPandas(measure, "doc_id long, trusted boolean, x binary")

    def train(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["trusted", "doc_id", "x"], ignore_index=True)
        x = np.array([np.frombuffer(r) for r in frame.x]).reshape(len(frame), len(FEATURES))
        mask = frame.trusted.to_numpy(bool)
        if not mask.any() or mask.all():
            return pd.DataFrame({"borders": [], "weights": [], "prior": []}, dtype=object)
        m = fit_pu(x[mask], x[~mask])
        return pd.DataFrame({"borders": [[b.tolist() for b in m.borders]], "weights": [m.weights.tolist()], "prior": [m.prior]})

    kind = "borders array<array<double>>, weights array<double>, prior double"
    done = rows.groupBy(F.lit(0).alias("all")).applyInPandas(train, kind).collect()
    if not done:
        return Model([], np.zeros(0), 0.5)
    return Model([np.array(b) for b in done[0].borders], np.array(done[0].weights), done[0].prior)


def score(documents: DataFrame, model: Model) -> DataFrame:
    """All columns and ``score``: nearer to 1 for better texts. It replaces a column of that name."""
    sent = documents.sparkSession.sparkContext.broadcast(model)  # a fixed number of weights

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts([as_bytes(t) for t in texts], sent.value))

    return documents.withColumn("score", scored("text"))
