"""Numbers, guarded the way candle arithmetic needs it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def no_nan(x: str | Column) -> Column:
    """NaN as null, so that nulls are the only missing values downstream."""
    return F.nanvl(x, F.lit(None).cast("double"))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def guarded_ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 unless b is positive."""
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def nonzero(x: Column, least: float = 1e-8) -> Column:
    """x, or least where it is nearer to zero than that."""
    return F.when(F.abs(x) < least, F.lit(least)).otherwise(x)


def class_sign(token: str | Column, n_classes: int | Column) -> Column:
    """1 above the middle class, -1 below it, else 0; for an even number of classes the upper middle one is the middle."""
    token, n = (F.col(token) if isinstance(token, str) else token), (F.lit(n_classes) if isinstance(n_classes, int) else n_classes)
    return F.signum(token - F.floor(n / 2)).cast("int")


def class_action(token: str | Column, n_classes: int | Column) -> Column:
    sign = class_sign(token, n_classes)
    return F.when(sign > 0, "buy").when(sign < 0, "sell").otherwise("hold")


def lenient_double(x: str | Column) -> Column:
    """A number of a text that begins with one, else 0; null is 0."""
    head = F.regexp_extract(F.trim(x), r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?", 0)
    return F.coalesce(head.try_cast("double"), F.lit(0.0))


def clipped_token(token: Column, n_classes: int) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(n_classes - 1), token))
