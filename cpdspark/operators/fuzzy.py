"""Words against word lists: edit distances, synonyms, and typo-aware priors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cpdspark.functions.text import boosted_score, edit_score, exponential_score


def shortened(word: Column, most: int) -> Column:
    """All texts that deleting at most ``most`` letters leaves of a word, itself included."""

    def one_less(w: Column) -> Column:
        n = F.length(w)
        places = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
        return F.transform(places, lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, n)))

    rounds = F.sequence(F.lit(1), F.lit(most)) if most else F.array().cast("array<int>")
    return F.aggregate(
        rounds, F.array(word), lambda found, _: F.array_distinct(F.concat(found, F.flatten(F.transform(found, one_less))))
    )


def nearest_words(df: DataFrame, attr: str, words: DataFrame, max_distance: int) -> DataFrame:
    """Distinct words of a column with the list's words within an edit distance: ``word, listed, distance``.

    Two words within ``d`` edits share one of the ``d + 1`` equal slices of the listed word,
    shifted by at most ``d`` places. Listed words no longer than ``d`` have no such slice; they meet
    words of up to ``2 d`` letters by what deleting up to ``d`` letters leaves of both, which is the same
    text somewhere if they are within ``d`` edits. So all pairs meet by equality, whatever the length.
    """
    d = max_distance
    own = df.select(F.col(attr).alias("word")).dropna().distinct()
    other = words.select(F.col(words.columns[0]).alias("listed")).dropna().distinct()
    length = F.length("listed")
    slice_len = F.floor(length / (d + 1)).cast("int")
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(d)),
        lambda i: F.struct(
            i.alias("i"),
            length.alias("n"),
            F.substring("listed", i * slice_len + 1, slice_len).alias("s"),
        ),
    )
    listed = other.filter(length > d).withColumn("_piece", F.explode(pieces))
    # A word of length n may meet list words of length n-d .. n+d, at shifts -d .. d.
    n = F.length("word")
    lengths = F.sequence(F.greatest(n - d, F.lit(d + 1)), F.greatest(n + d, F.lit(d + 1)))
    grid = F.flatten(
        F.transform(
            lengths,
            lambda m: F.flatten(
                F.transform(
                    F.sequence(F.lit(0), F.lit(d)),
                    lambda i: F.transform(
                        F.sequence(F.lit(-d), F.lit(d)),
                        lambda s: F.struct(
                            i.alias("i"),
                            m.alias("n"),
                            F.substring(
                                F.col("word"),
                                F.greatest(i * F.floor(m / (d + 1)).cast("int") + 1 + s, F.lit(1)),
                                F.floor(m / (d + 1)).cast("int"),
                            ).alias("s"),
                        ),
                    ),
                )
            ),
        )
    )
    asked = own.withColumn("_piece", F.explode(F.array_distinct(grid)))
    met = asked.join(listed, "_piece").select("word", "listed").distinct()
    left_over = lambda c: F.explode(shortened(F.col(c), d)).alias("_rest")
    short = other.filter(F.length("listed") <= d).select("listed", left_over("listed"))
    tiny = own.filter(F.length("word") <= 2 * d).select("word", left_over("word"))
    pairs = met.unionByName(tiny.join(short, "_rest").select("word", "listed").distinct())
    return pairs.withColumn("distance", F.levenshtein("word", "listed")).filter(F.col("distance") <= d)


def first_synonym(df: DataFrame, id_col: str, keywords: str, synonyms: DataFrame, separator: str = ", ") -> DataFrame:
    """``id, keyword, synonym``: the first keyword of the list that has a synonym; null if none has."""
    long = df.select(id_col, F.posexplode(F.split(keywords, separator)).alias("_pos", "keyword"))
    found = long.join(synonyms, "keyword", "left")
    hit = F.when(F.col("synonym").isNotNull(), F.col("_pos"))
    best = F.min_by(F.struct("keyword", "synonym"), hit)
    return found.groupBy(id_col).agg(best.alias("_b")).select(
        id_col, F.col("_b.keyword").alias("keyword"), F.col("_b.synonym").alias("synonym")
    )


def dictionary_prior(
    observed: DataFrame,
    word: str,
    dictionary: DataFrame,
    entry: str,
    parent: tuple[str, str],
    code: tuple[str, str] | None = None,
    weighting: str = "boosted",
    near: float | None = None,
) -> DataFrame:
    """Probability of each dictionary entry as the intended word, per distinct observation.

    Weight is the edit score, raised for good matches (``boosted``) or exponential. ``parent``
    (column, dictionary column) names what an observation and its entries must share, so that no word
    meets the whole dictionary; ``code`` multiplies by the edit score of a second field.

    With ``near``, only entries whose edit score is above it get a row of their own; all others of an
    observation together are one row with a null entry, their weights and probabilities added up. ``entries``
    is then the number of entries of a row. So the result has about as many rows as words have near entries.
    """
    keys = [word, parent[0]] + ([code[0]] if code else [])
    asked = observed.select(*keys).dropna().distinct()
    joined = asked.join(dictionary, F.col(parent[0]) == F.col(parent[1]))
    score = edit_score(F.col(word), F.col(entry))
    weight: Column = boosted_score(score) if weighting == "boosted" else exponential_score(score)
    if code:
        weight = weight * edit_score(F.col(code[0]).cast("string"), F.col(code[1]).cast("string"))
    weighted = joined.select(*keys, entry, score.alias("_score"), weight.alias("weight"))
    is_far = F.lit(False) if near is None else F.col("_score") <= near
    # added up before the shuffle; the rows themselves follow by a join, so no observation's entries meet in one task
    totals = weighted.groupBy(*keys).agg(
        F.sum("weight").alias("_total"),
        F.sum(F.when(is_far, F.col("weight"))).alias("_rest"),
        F.count(F.when(is_far, F.lit(1))).alias("_far"),
    )
    prob = lambda w: F.when(F.col("_total") > 0, w / F.when(F.col("_total") > 0, F.col("_total"))).otherwise(F.lit(0.0))
    listed = weighted.filter(~is_far).join(totals, keys).select(*keys, entry, "weight", prob(F.col("weight")).alias("prob"))
    if near is None:
        return listed
    nobody = F.lit(None).cast(dictionary.schema[entry].dataType).alias(entry)
    rest = totals.filter("_far > 0").select(
        *keys, nobody, F.col("_rest").alias("weight"), prob(F.col("_rest")).alias("prob"), F.col("_far").alias("entries")
    )
    return listed.withColumn("entries", F.lit(1).cast("long")).unionByName(rest)
