"""Column names for tables whose other columns pass through an operator."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def fresh(columns: list[str], wanted: str) -> str:
    """``wanted``, with underscores behind it until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def others(columns: list[str], *results: str) -> list[Column]:
    """The columns that pass through: all but those that an operator's results replace."""
    names = {r.lower() for r in results}
    return [F.col(f"`{c}`") for c in columns if c.lower() not in names]
