"""Arrays of probabilities, levels and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def expected_position(p: str | Column) -> Column:
    """Expected class, with the middle at 0 and the ends at -1 and 1; null for fewer than two probabilities."""
    mid = (F.size(p) - 1) / F.lit(2.0)
    total = F.aggregate(F.transform(p, lambda x, i: x * ((i - mid) / mid)), F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(p) > 1, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), total)))


def nearest(levels: str | Column, price: Column, support: bool) -> Column:
    """The highest level at or below the price (support), or the lowest at or above it; null for a price of 0 or none such."""
    found = F.array_max(F.filter(levels, lambda x: x <= price)) if support else F.array_min(F.filter(levels, lambda x: x >= price))
    return F.when(price != 0, found)


def unique(x: str | Column) -> Column:
    return F.array_distinct(x)


def first_five(x: str | Column) -> Column:
    return F.slice(x, 1, 5)


def argmax(p: str | Column) -> Column:
    """Index of the largest, the first of equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def top_probability(p: str | Column) -> Column:
    return F.array_max(p)


def padded_probabilities(by_class: Column, n_classes: int) -> Column:
    """An array of n_classes from a map of class to probability; absent classes have 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(n_classes - 1)), lambda k: F.coalesce(F.try_element_at(by_class, k), F.lit(0.0)))


def flat(rows: str | Column) -> Column:
    """Time-major, feature after feature."""
    return F.flatten(rows)
