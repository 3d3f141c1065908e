"""Sliding windows of rows as arrays: for models, for sequences, for token contexts, and the last of each series. Windows are made over
blocks of series, with the rows before each block that they reach.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flat
from ..session import SERIES
from .blocks import DEALT, ROWS, dealt, numbered
from .features import series


def feature_row(columns: list[str]) -> Column:
    """An array that is never null itself, so that no row is lost when rows are collected."""
    return F.array(*[F.col(c).cast("double") for c in columns])


def sequence_windows(df: DataFrame, length: int, columns: list[str], keys: tuple[str, ...] = SERIES, token: str | None = "token") -> DataFrame:
    """df with window, the last `length` rows of features as an array of rows, for rows with so much history and a valid token."""
    parts, _ = dealt(df, keys, length, ROWS)
    w = series((*keys, "_block"))
    parts = parts.withColumn("window", F.collect_list(feature_row(columns)).over(w.rowsBetween(1 - length, 0))).where("_own").where(F.size("window") == length).drop(*DEALT)
    return parts.where(F.col(token) != -1) if token else parts


def tabular_windows(df: DataFrame, length: int, columns: list[str], keys: tuple[str, ...] = SERIES, token: str | None = "token") -> DataFrame:
    """The same with each window flattened, row after row."""
    return sequence_windows(df, length, columns, keys, token).withColumn("window", flat("window"))


def token_windows(df: DataFrame, length: int, horizon: int, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """df with context, the `length` tokens that were known `horizon` rows before; rows with an unknown token anywhere go."""
    parts, _ = dealt(df, keys, horizon + length, ROWS)
    context = F.collect_list("token").over(series((*keys, "_block")).rowsBetween(-(horizon + length - 1), -horizon))
    return parts.withColumn("context", context).where("_own").drop(*DEALT).where((F.size("context") == length) & ~F.array_contains("context", -1) & (F.col("token") != -1))


def last_windows(df: DataFrame, length: int, columns: list[str], keys: tuple[str, ...] = SERIES) -> DataFrame:
    """One row for each series with its last `length` rows of features, and end, its last time; series with fewer rows have none."""
    last = numbered(df, keys).where(F.col("_place") >= F.col("_total") - length)
    rows = last.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("begin", feature_row(columns).alias("x")))).alias("_rows"))
    return rows.where(F.size("_rows") == length).select(*keys, F.element_at("_rows", -1)["begin"].alias("last_begin"), F.transform("_rows", lambda r: r["x"]).alias("window"))
