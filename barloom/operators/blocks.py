"""Places of rows in series of any length, and windows over blocks of them, without a task that holds a series.

Candles are counted by series and day. The counts, of which there are as many as days, are summed up in order; a day's rows are put in order
by themselves. So a row's place is its day's start and its place in the day.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

#: The columns of rows dealt in blocks.
DEALT = ("_block", "_own", "_start")
#: Rows of a block, but for its last day.
ROWS = 1 << 16


def day_counts(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(_key for each key, _day, _size, _before, _all): rows of each day, of the days before, and of the whole series."""
    days = df.where(F.col("begin").isNotNull()).groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.to_date("begin").alias("_day")).agg(F.count("*").alias("_size"))
    series = Window.partitionBy(*[f"_{k}" for k in keys])
    return days.withColumns({"_before": F.sum("_size").over(series.orderBy("_day")) - F.col("_size"), "_all": F.sum("_size").over(series)})


def of_day(df: DataFrame, keys: tuple[str, ...]) -> list[Column]:
    """The condition by which rows meet what was found out about their day."""
    return [*[F.col(k) == F.col(f"_{k}") for k in keys], F.to_date("begin") == F.col("_day")]


def numbered(df: DataFrame, keys: tuple[str, ...], place: str = "_place", total: str = "_total") -> DataFrame:
    """df with each row's place in its series by begin, from 0 on, and the series' rows. Both are null for rows without a begin or a key."""
    rows = df.join(day_counts(df, keys), of_day(df, keys), "left")
    in_day = F.row_number().over(Window.partitionBy(*keys, F.to_date("begin")).orderBy("begin")) - 1
    return rows.withColumns({place: F.when(F.col("_before").isNotNull(), F.col("_before") + in_day), total: F.col("_all")}).drop(*[f"_{k}" for k in keys], "_day", "_size", "_before", "_all")


def in_blocks(df: DataFrame, keys: tuple[str, ...], back: int, size: int = ROWS) -> DataFrame:
    return dealt(df, keys, back, size)[0]


def dealt(df: DataFrame, keys: tuple[str, ...], back: int, size: int = ROWS, ahead: int = 0) -> tuple[DataFrame, bool]:
    """Whether a series has many blocks, and df with _block, _own and _start: rows of a series dealt in blocks of some `size` rows, whole
    days each, and around each block copies (not _own) of the days that hold the `back` rows before it and the `ahead` rows after it.
    _start is the place of a block's first row, copies included.

    Windows that look back at most `back` rows and forward at most `ahead` give within (keys, _block) what they give within keys. Rows
    without a begin or a key have a block of their own. Days are counted at once; where no series has more rows than a block, that
    is all there is to do.
    """
    named = [f"_{k}" for k in keys]
    counts = stored(day_counts(df, keys), "days")
    if (counts.agg(F.max("_all")).first()[0] or 0) <= size:
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*keys, "begin")])
        return df.withColumns({"_block": F.when(known, 0).otherwise(-1), "_own": F.lit(True), "_start": F.lit(0)}), False
    days = counts.withColumn("_block", F.floor(F.col("_before") / size))
    blocks = days.groupBy(*[F.col(k).alias(f"_of{k}") for k in named], F.col("_block").alias("_to")).agg(F.min("_before").alias("_begin"), F.max(F.col("_before") + F.col("_size")).alias("_finish"))
    starts, ends = F.col("_before"), F.col("_before") + F.col("_size")
    earlier = (ends <= F.col("_begin")) & (ends > F.col("_begin") - back)
    later = (starts >= F.col("_finish")) & (starts < F.col("_finish") + ahead)
    halo = days.join(blocks, [*[F.col(k) == F.col(f"_of{k}") for k in named], earlier | later]).select(*named, "_day", F.col("_to").alias("_block"), F.lit(False).alias("_own"), "_before")
    homes = days.select(*named, "_day", "_block", F.lit(True).alias("_own"), "_before").unionByName(halo)
    homes = homes.withColumn("_start", F.min("_before").over(Window.partitionBy(*named, "_block")))
    rows = df.join(homes, of_day(df, keys), "left").drop(*named, "_day", "_before")
    return rows.fillna(-1, ["_block"]).fillna(0, ["_start"]).fillna(True, ["_own"]), True


def running(df: DataFrame, keys: tuple[str, ...], how: str, value: Column, into: str, many: bool) -> DataFrame:
    """df, dealt in blocks and without their copies, with the sum, product or max of a value over a series so far, itself included.

    Each block's own is carried over the blocks, of which there are few, and met with what is so far within a block.
    """
    total = {"sum": F.sum, "product": F.product, "max": F.max}[how]
    df = df.withColumn(into, total(value).over(Window.partitionBy(*keys, "_block").orderBy("begin").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if not many:
        return df
    named = [f"_{k}" for k in keys]
    sums = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_of")).agg(total(value).alias("_sum"))
    before = Window.partitionBy(*named).orderBy("_of").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(*named, "_of", total("_sum").over(before).alias("_carry"))
    a, b = F.col(into), F.col("_carry")
    both = {"sum": a + b, "product": a * b, "max": F.greatest(a, b)}[how]
    met = df.join(carried, [*[F.col(k) == F.col(f"_{k}") for k in keys], F.col("_block") == F.col("_of")], "left")
    return met.withColumn(into, F.coalesce(both, a, b)).drop(*named, "_of", "_carry")
