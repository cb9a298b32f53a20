"""Vector similarity on array columns, inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from cpdspark.functions.distributions import safe_div


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_similarity(a: Column, b: Column) -> Column:
    return safe_div(dot(a, b), norm(a) * norm(b))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - cosine_similarity(a, b)
