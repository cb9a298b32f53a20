"""Value codes, similarity features, and value embeddings learnt from co-occurrence."""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from cpdspark.functions.lineage import VECTOR_ROWS, cut
from cpdspark.functions.rng import tagged
from cpdspark.functions.vectors import cosine_similarity, dot
from cpdspark.operators.cumulative import rank_in, global_rank
from cpdspark.operators.knn import vector_column, with_vectors


def values_long(df: DataFrame, attrs: list[str]) -> DataFrame:
    """Distinct (attr, value) of several columns, values as text."""
    cells = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attrs])
    return df.select(F.explode(cells).alias("_c")).select("_c.*").dropna().distinct()


def vocabulary(df: DataFrame, attrs: list[str]) -> DataFrame:
    """``attr, value, code``: codes 0, 1, ... per column in sorted order."""
    return rank_in(values_long(df, attrs), ["attr"], "value", "code")


def single_vocabulary(df: DataFrame, attrs: list[str]) -> DataFrame:
    """``attr, value, code`` with one code per distinct value over all columns."""
    pairs = values_long(df, attrs)
    codes = global_rank(pairs.select("value").distinct(), "value", "code")
    return pairs.join(codes, "value").select("attr", "value", "code")


def encoded(df: DataFrame, vocab: DataFrame, attrs: list[str]) -> DataFrame:
    """The table with the listed columns replaced by their codes."""
    out = df
    for a in attrs:
        codes = vocab.filter(F.col("attr") == a).select(F.col("value").alias("_v"), F.col("code").alias(f"_code_{a}"))
        out = out.join(codes, F.col(a).cast("string") == F.col("_v"), "left").drop("_v", a)
        out = out.withColumnRenamed(f"_code_{a}", a)
    return out


def adaptive_dimension(df: DataFrame, attr: str, dim: int) -> DataFrame:
    """``min(dim, floor(V ** 0.25))`` for a column of V values."""
    size = df.agg(F.countDistinct(attr).alias("n_values"))
    root = F.floor(F.pow(F.col("n_values").cast("double"), F.lit(0.25))).cast("long")
    return size.select("n_values", F.least(F.lit(dim).cast("long"), root).alias("dim"))


def pair_features(
    df: DataFrame, emb: DataFrame, cats: list[str], nums: list[str], keep: list[str] = (), normalize: bool = True
) -> DataFrame:
    """Similarity of all pairs of a row's values, ``sim_<a>_<b>``, and its numeric columns."""
    wide = with_vectors(df.select(*keep, *cats, *nums), emb, cats)
    sim = cosine_similarity if normalize else dot
    pairs = [
        sim(F.col(vector_column(a)), F.col(vector_column(b))).alias(f"sim_{a}_{b}") for a, b in combinations(cats, 2)
    ]
    return wide.select(*keep, *pairs, *nums)


def embeddings_by_context(df: DataFrame, attrs: list[str], dim: int, seed: int) -> DataFrame:
    """``attr, value, vec`` from the company that values keep in rows.

    For each pair of values of two columns the positive pointwise mutual information is taken from
    their counts, and a value's row of these numbers is projected to ``dim`` numbers by random signs,
    which are hashes of the seed and the other value. Counts, sums and vectors are distributed tables
    throughout; values with similar company get vectors of similar direction.
    """
    word = lambda a: F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value"))
    met = F.array(*[F.struct(word(a).alias("w"), word(c).alias("c")) for a in attrs for c in attrs if a != c])
    pairs = df.select(*attrs).dropna().select(F.explode(met).alias("p")).groupBy("p.w", "p.c").agg(F.count(F.lit(1)).alias("n"))
    pairs = cut(pairs)
    own = pairs.groupBy("w").agg(F.sum("n").alias("n_w"))
    other = own.select(F.col("w").alias("c"), F.col("n_w").alias("n_c"))  # pairs are symmetric
    total = pairs.agg(F.sum("n")).scalar()
    ratio = F.col("n") * F.col("_total") / (F.col("n_w").cast("double") * F.col("n_c"))
    known = pairs.join(own, "w").join(other, "c").withColumn("_total", total)
    weighed = known.withColumn("ppmi", F.greatest(F.ln(ratio), F.lit(0.0)))
    sign = [F.when(tagged(seed, f"sign{i}", "c.attr", "c.value") < 0.5, F.lit(-1.0)).otherwise(F.lit(1.0)) for i in range(dim)]
    sums = weighed.groupBy("w").agg(*[(F.sum(F.col("ppmi") * s) / math.sqrt(dim)).alias(f"v{i}") for i, s in enumerate(sign)])
    return sums.select("w.attr", "w.value", F.array(*[f"v{i}" for i in range(dim)]).alias("vec"))


def learn_embeddings(
    rows: DataFrame,
    attrs: list[str],
    nums: list[str],
    label: str,
    dim: int,
    epochs: int,
    seed: int,
    rate: float = 0.5,
) -> tuple[DataFrame, dict[str, float]]:
    """Value vectors such that a logistic model on their pairwise dot products tells good rows from bad.

    Rows are reduced to distinct tuples. In each epoch the tuples look up their vectors by joins,
    tasks add up the gradients of their tuples per value, and Spark sums these per value. Vectors
    are a distributed table throughout; only the few output weights are on the driver. Each value's
    step is divided by its number of rows, so frequent values do not dominate.

    Returns ``(attr, value, vec)`` and the output weights.
    """
    total_rows = F.count(F.lit(1)).alias("_w")
    stats = rows.agg(*[f(n).alias(f"{t}_{n}") for n in nums for t, f in (("m", F.avg), ("s", F.stddev_samp))]).first() if nums else {}
    scaled = rows.select(
        *[F.col(a).cast("string").alias(a) for a in attrs],
        *[((F.col(n) - stats[f"m_{n}"]) / (stats[f"s_{n}"] or 1.0)).alias(n) for n in nums],
        F.col(label).cast("double").alias("_y"),
    ).dropna()
    tuples = cut(scaled.groupBy(*attrs, *nums, "_y").agg(total_rows))
    n_rows = tuples.agg(F.sum("_w")).first()[0]
    limit = math.sqrt(6.0 / (1 + dim))
    init = F.array(*[(tagged(seed, f"init{i}", "attr", "value") * 2 - 1) * limit for i in range(dim)])
    cells = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).alias("value")) for a in attrs])
    occurrences = (
        tuples.select(F.explode(cells).alias("_c"), "_w")
        .groupBy(F.col("_c.attr").alias("attr"), F.col("_c.value").alias("value"))
        .agg(F.sum("_w").alias("_n"))
    )
    emb = cut(occurrences.withColumn("vec", init))
    small = emb.count() <= VECTOR_ROWS
    pairs = list(combinations(range(len(attrs)), 2))
    weights = np.zeros(len(pairs) + len(nums) + 1)
    weights[: len(pairs)] = 1.0
    out_schema = "attr string, value string, grad array<double>"

    def gradients(w: np.ndarray):
        def task(batches):
            for pdf in batches:
                vecs = [np.stack(pdf[vector_column(a)].to_numpy()) for a in attrs]
                sims = np.stack([(vecs[i] * vecs[j]).sum(1) for i, j in pairs], axis=1)
                x = np.concatenate([sims, pdf[nums].to_numpy(float).reshape(len(pdf), -1), np.ones((len(pdf), 1))], axis=1)
                z = np.clip(x @ w, -30, 30)
                err = (1 / (1 + np.exp(-z)) - pdf["_y"].to_numpy()) * pdf["_w"].to_numpy()
                frames = []
                for i, a in enumerate(attrs):
                    g = np.zeros_like(vecs[i])
                    for p, (u, v) in enumerate(pairs):
                        if i in (u, v):
                            g += (err * w[p])[:, None] * vecs[v if i == u else u]
                    codes, uniques = pd.factorize(pdf[a])
                    summed = np.zeros((len(uniques), dim))
                    np.add.at(summed, codes, g)
                    frames.append(pd.DataFrame({"attr": a, "value": uniques, "grad": list(summed)}))
                frames.append(pd.DataFrame({"attr": [""], "value": [""], "grad": [list(err @ x)]}))
                yield pd.concat(frames)

        return task

    for _ in range(epochs):
        wide = with_vectors(tuples, F.broadcast(emb) if small else emb, attrs)
        partial = wide.mapInPandas(gradients(weights), out_schema)
        summed = cut(
            partial.groupBy("attr", "value").agg(
                vector_to_array(Summarizer.sum(array_to_vector(F.col("grad")))).alias("grad")
            )
        )
        out_grad = summed.filter("attr = ''").select("grad").first()[0]
        step = F.lit(rate) / F.col("_n")
        moved = F.zip_with("vec", "grad", lambda v, g: v - step * g)
        emb = cut(
            emb.join(summed, ["attr", "value"], "left").select(
                "attr", "value", "_n", F.when(F.col("grad").isNotNull(), moved).otherwise(F.col("vec")).alias("vec")
            )
        )
        weights = weights - rate * np.asarray(out_grad) / n_rows
    names = [f"sim_{attrs[i]}_{attrs[j]}" for i, j in pairs] + list(nums) + ["bias"]
    return emb.select("attr", "value", "vec"), dict(zip(names, weights.tolist()))


def plausibility_model(features: DataFrame, inputs: list[str], label: str, iterations: int = 50) -> LogisticRegressionModel:
    """Logistic classifier of good and bad rows on similarity features."""
    data = VectorAssembler(inputCols=inputs, outputCol="_x").transform(features)
    return LogisticRegression(featuresCol="_x", labelCol=label, maxIter=iterations, regParam=1e-4).fit(data)


def plausibility(model: LogisticRegressionModel, features: DataFrame, inputs: list[str]) -> DataFrame:
    """Features with ``plausibility``, the probability of being a good row."""
    data = VectorAssembler(inputCols=inputs, outputCol="_x").transform(features)
    scored = model.transform(data)
    return scored.withColumn("plausibility", vector_to_array("probability")[1]).drop(
        "_x", "rawPrediction", "probability", "prediction"
    )


def target_encoding(df: DataFrame, attrs: list[str], target: str) -> DataFrame:
    """``attr, value, n, encoding``: mean target per value, a one-dimensional embedding."""
    cells = F.array(*[F.struct(F.lit(a).alias("attr"), F.col(a).cast("string").alias("value")) for a in attrs])
    long = df.select(F.explode(cells).alias("_c"), F.col(target).alias("_t")).select("_c.*", "_t").dropna()
    return long.groupBy("attr", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("_t").alias("encoding"))
