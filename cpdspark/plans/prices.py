"""Price rules for synthetic facts: surcharges by year and size, as data."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class YearStep:
    """From one year (inclusive) until another (exclusive): a surcharge per unit, and one more for each year."""

    start: int
    until: int
    extra: float = 0.0
    per_year: float = 0.0


@dataclass(frozen=True)
class PriceRule:
    """Price per unit of space: the base, an offset, the year's surcharge, and the size's."""

    offset: float
    years: tuple[YearStep, ...]
    pivot: float  # space without a surcharge
    slope: float  # per unit of space below it; above it a discount
    least: float  # lower prices are replaced by observed ones


# Fixed values of the apartment rule.
RENT_PRICES = PriceRule(
    offset=2.5,
    years=(YearStep(0, 1949, 1.5), YearStep(1949, 1969, -1.0), YearStep(1990, 10_000, 0.0, 0.25)),
    pivot=100.0,
    slope=0.0425,
    least=100.0,
)
