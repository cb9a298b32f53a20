"""Edit distances and typos on string columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cpdspark.functions.distributions import EDIT_ERROR_BASE, EDIT_ERROR_TERMS
from cpdspark.functions.rng import RESOLUTION_BITS, pick_index, tagged


def edit_score(a: Column, b: Column) -> Column:
    """Similarity in [0, 1]: best of the plain and the token-sorted normalised edit distance."""

    def plain(x: Column, y: Column) -> Column:
        longest = F.greatest(F.length(x), F.length(y))
        return F.when(longest > 0, 1.0 - F.levenshtein(x, y) / F.when(longest > 0, longest)).otherwise(1.0)

    def sorted_tokens(x: Column) -> Column:
        return F.concat_ws(" ", F.array_sort(F.split(x, " ")))

    return F.greatest(plain(a, b), plain(sorted_tokens(a), sorted_tokens(b)))


def boosted_score(score: Column, factor: float = 5.0, threshold: float = 0.5) -> Column:
    """Good matches weigh ``factor`` times as much."""
    return F.when(score > threshold, score * factor).otherwise(score)


def exponential_score(score: Column, factor: float = 5.0) -> Column:
    return F.exp(score * factor)


def typo_count(u: Column) -> Column:
    """Number of typos by inverse CDF: mass of i typos is proportional to ``EDIT_ERROR_BASE ** i``."""
    total = sum(EDIT_ERROR_BASE**i for i in range(EDIT_ERROR_TERMS))
    out = F.lit(0)
    acc = 0.0
    for i in range(EDIT_ERROR_TERMS):  # the terms of the distribution itself; none is left out
        acc += EDIT_ERROR_BASE**i / total
        out = F.when(u >= acc, F.lit(i + 1)).otherwise(out)
    return out


def halving_typo_count(seed: int, prob: float, *key: Column) -> Column:
    """Typos added one after the other, each with half the chance of the one before.

    A draw is a whole number of ``2 ** -RESOLUTION_BITS``: from as many steps on, no draw is below the chance.
    """
    out = F.lit(0)
    for i in reversed(range(RESOLUTION_BITS + 1)):
        out = F.when(tagged(seed, f"more{i}", *key) < prob / 2**i, F.lit(1) + out).otherwise(F.lit(0))
    return out


def one_typo(word: Column, action: Column, letter: Column, u_pos: Column) -> Column:
    """Insert (0), remove (1) or replace (2) one letter; replacing hits all equal letters."""
    n = F.length(word)
    at = pick_index(u_pos, F.when(action == 0, n + 1).otherwise(n)).cast("int") + 1
    inserted = F.concat(F.substring(word, F.lit(1), at - 1), letter, F.substring(word, at, n))
    removed = F.concat(F.substring(word, F.lit(1), at - 1), F.substring(word, at + 1, n))
    replaced = F.replace(word, F.substring(word, at, F.lit(1)), letter)
    changed = F.when(action == 0, inserted).when(action == 1, removed).otherwise(replaced)
    return F.when((n == 0) & (action != 0), word).otherwise(changed)


def add_typos(word: Column, count: Column, seed: int, *key: Column | str) -> Column:
    """Apply ``count`` random typos to a word, one after the other."""

    def step(acc: Column, i: Column) -> Column:
        action = pick_index(tagged(seed, "action", i, *key), F.lit(3))
        letter = F.char(F.lit(97) + pick_index(tagged(seed, "letter", i, *key), F.lit(26)))
        return one_typo(acc, action, letter, tagged(seed, "pos", i, *key))

    steps = F.when(count > 0, F.sequence(F.lit(1), count)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, word, step)
