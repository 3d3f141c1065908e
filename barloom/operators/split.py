"""Splits by time, position by position within each series. No task holds a series."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import SERIES
from .blocks import numbered


def time_split(df: DataFrame, train: float = 0.7, val: float = 0.15, test: float = 0.15, least_train: int = 1000, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """df with split: train, then val, then test in order of time. Series too short for the least training size are null."""
    if abs(train + val + test - 1) >= 1e-6:
        raise ValueError(f"shares sum to {train + val + test}")
    df, n, i = numbered(df, keys), F.col("_total"), F.col("_place")
    first = F.floor(n * F.lit(train))
    second = F.floor(n * F.lit(train + val))
    short = first < least_train
    second = F.when(short, least_train + F.floor((n - least_train) * F.lit(val) / F.lit(val + test))).otherwise(second)
    first = F.when(short, F.lit(least_train)).otherwise(first)
    name = F.when(i < first, "train").when(i < second, "val").otherwise("test")
    return df.withColumn("split", F.when(n >= least_train, name)).drop("_place", "_total")


def with_positions(df: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """df of time_split with position, a candle's place in its series from 0 on, and split_position, its place in its split."""
    df = numbered(df, keys, "position").withColumn("_part", F.coalesce("split", F.lit("")))
    df = numbered(df, (*keys, "_part"), "split_position")
    return df.withColumns({c: F.col(c).cast("int") for c in ("position", "split_position")}).drop("_total", "_part")


def leaks(df: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Series whose splits overlap in time; empty splits overlap nothing."""
    at = lambda f, s: f(F.when(F.col("split") == s, F.col("begin")))
    ends = df.groupBy(*keys).agg(at(F.max, "train").alias("train_end"), at(F.min, "val").alias("val_begin"), at(F.max, "val").alias("val_end"), at(F.min, "test").alias("test_begin"))
    return ends.where("train_end >= val_begin or val_end >= test_begin or train_end >= test_begin")


def split_periods(df: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Begin, end and rows of each split."""
    return df.groupBy(*keys, "split").agg(F.min("begin").alias("start"), F.max("begin").alias("finish"), F.count("*").alias("n"))


def walk_forward(df: DataFrame, n_splits: int, train_size: int, test_size: int, gap: int = 0, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """A row for each fold and part (train, test) that a candle belongs to. Training grows by test_size from fold to fold; folds
    for which a series has too few rows are left out.
    """
    df = numbered(df, keys, "_i", "_n").withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    end = F.lit(train_size) + F.col("fold") * test_size
    part = F.when(F.col("_i") < end, "train").when((F.col("_i") >= end + gap) & (F.col("_i") < end + gap + test_size), "test")
    return df.where(F.col("_n") >= end + gap + test_size).withColumn("part", part).where("part is not null").drop("_n", "_i")
