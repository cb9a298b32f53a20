"""Log densities as column expressions, safe under ANSI mode.

Spark's ANSI mode raises on a division by zero and ``ln(0)`` is null, so every function
guards those inputs and yields minus infinity or NaN as IEEE arithmetic would.
A new distribution is just another function from columns to a column.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Fixed values of the method.
NEGATIVE_PENALTY = -66.0  # log density of a negative value under the half normal
EDIT_ERROR_BASE = 0.05  # one more edit is this much as likely
EDIT_ERROR_TERMS = 50  # 0 .. 49 edits have mass
UNSEEN_SHARE = 0.1  # mass of the unseen values, as a share of the seen mass


def neg_inf() -> Column:
    return F.lit(float("-inf"))


def nan() -> Column:
    return F.lit(float("nan"))


def safe_ln(x: Column) -> Column:
    """``ln`` with ``ln(0) = -inf`` and NaN below zero; null stays null."""
    return F.when(x > 0, F.ln(x)).when(x == 0, neg_inf()).when(x.isNotNull(), nan())


def safe_div(a: Column, b: Column) -> Column:
    """``a / b`` with NaN for a zero divisor."""
    return F.when(b != 0, a / F.when(b != 0, b)).when(b.isNotNull(), nan())


def uniform_categorical(domain_size: Column, seen: Column | None = None) -> Column:
    value = -F.ln(domain_size.cast("double"))
    return value if seen is None else F.when(seen, value).otherwise(neg_inf())


def named_categorical(weight: Column, total: Column) -> Column:
    """Log of a weight's share; a label that is not listed (null weight) has no mass."""
    return safe_ln(F.coalesce(safe_div(weight.cast("double"), total.cast("double")), F.lit(0.0)))


def uniform_continuous(x: Column, low: Column, high: Column) -> Column:
    return F.when((x >= low) & (x <= high), -safe_ln((high - low).cast("double"))).otherwise(neg_inf())


def normal(x: Column, mean: Column, std: Column) -> Column:
    var = std * std
    ok = F.when(var > 0, var)
    body = -((x - mean) * (x - mean)) / (ok * 2.0) - 0.5 * F.ln(ok * (2.0 * math.pi))
    return F.when(var > 0, body).otherwise(nan())


def half_normal(x: Column, mean: Column, std: Column) -> Column:
    """The plain normal formula, with a fixed penalty below zero (not renormalised)."""
    return F.when(x < 0, F.lit(NEGATIVE_PENALTY)).otherwise(normal(x, mean, std))


def log_normal(x: Column, mu: Column, std: Column) -> Column:
    ok = F.when((x > 0) & (std > 0), x)
    diff = F.ln(ok) - mu
    pos_std = F.when(std > 0, std)
    body = -(diff * diff) / (pos_std * pos_std * 2.0) - F.lit(0.5 * math.log(2.0 * math.pi)) - F.ln(ok * pos_std)
    return F.when((x > 0) & (std > 0), body).when((std > 0) & (x <= 0), neg_inf()).otherwise(nan())


def bernoulli(flag: Column, p: Column) -> Column:
    return F.when(flag, safe_ln(p)).otherwise(safe_ln(1.0 - p))


def edit_error(distance: Column) -> Column:
    """Log mass of a word that is ``distance`` edits away from the intended one."""
    log_norm = math.log(sum(EDIT_ERROR_BASE**i for i in range(EDIT_ERROR_TERMS)))
    return F.when(distance < EDIT_ERROR_TERMS, distance * math.log(EDIT_ERROR_BASE) - log_norm).otherwise(neg_inf())


def smoothed_categorical(count: Column, total: Column, seen_values: Column, domain_size: Column) -> Column:
    """Mass of a value seen ``count`` times among ``total`` matches.

    Unseen domain values share ``UNSEEN_SHARE`` of the seen mass, if there are any. With no
    match at all every domain value gets the same mass.
    """
    unseen = domain_size - seen_values
    spread = 1.0 + UNSEEN_SHARE
    total_d = F.when(total > 0, total.cast("double"))
    seen_p = F.when(unseen > 0, count / (total_d * spread)).otherwise(count / total_d)
    unseen_p = UNSEEN_SHARE / (spread * F.when(unseen > 0, unseen))
    return F.when(total == 0, 1.0 / domain_size).when(count > 0, seen_p).otherwise(unseen_p)


def log_sum_exp(parts: list[Column]) -> Column:
    """Log of a sum of exponentials of a fixed list of columns (null parts do not count)."""
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    total = sum((F.coalesce(F.exp(p - top), F.lit(0.0)) for p in parts), F.lit(0.0))
    return F.when(top == neg_inf(), neg_inf()).otherwise(top + F.ln(total))
