"""Counter-based randomness: a draw depends on its key only, never on the partitioning.

The key is a seed plus integer or string columns; the draw is a hash of it. A lost
executor that recomputes a task therefore draws the same numbers again.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

RESOLUTION_BITS = 48


def unit(seed: int, *key: Column | str) -> Column:
    """Uniform draw in [0, 1) for one key."""
    parts = [F.col(k) if isinstance(k, str) else k for k in key]
    text = F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, RESOLUTION_BITS // 4), 16, 10).cast("double") / float(2**RESOLUTION_BITS)


def tagged(seed: int, tag: str, *key: Column | str) -> Column:
    """As :func:`unit`, with a literal tag that separates independent draws of one row."""
    return unit(seed, F.lit(tag), *key)


def pick_index(u: Column, size: Column) -> Column:
    """Turn a uniform draw into an index 0 .. size-1."""
    return F.least(F.floor(u * size), size - 1).cast("long")


def standard_normal(u1: Column, u2: Column) -> Column:
    """Box-Muller transform of two uniform draws."""
    safe = F.greatest(u1, F.lit(2.0**-RESOLUTION_BITS))
    return F.sqrt(F.lit(-2.0) * F.ln(safe)) * F.cos(F.lit(2.0 * math.pi) * u2)


def gumbel(u: Column) -> Column:
    """Standard Gumbel noise: the argmax of ``log weight + gumbel`` is a weighted draw."""
    safe = F.greatest(u, F.lit(2.0**-RESOLUTION_BITS))
    return -F.ln(-F.ln(safe))
