"""Indicators of candles: ordered window expressions over blocks of each series, in one pass over one partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import calendar, guarded_ratio
from ..session import SERIES
from .blocks import ROWS, in_blocks

ATR, VOLATILITY, VOLUME, RETURNS, SPANS = 14, 20, 20, (1, 3, 5), (9, 20, 50)
#: Model inputs in the order in which models take them.
FEATURES = (
    "open", "high", "low", "close", "volume", "value", "return_1", "return_3", "return_5", "atr", "rolling_volatility", "volume_ratio", "body", "range", "upper_wick", "lower_wick",
    "body_ratio", "upper_wick_ratio", "lower_wick_ratio", "ema_9_distance", "ema_20_distance", "ema_50_distance", "hour", "day_of_week", "month",
)


def series(keys: tuple[str, ...] = SERIES) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("begin")


def full(x: Column, of: Column, w: WindowSpec, n: int) -> Column:
    """An aggregate over a frame, null unless the frame has n values."""
    return F.when(F.count(of).over(w) == n, x.over(w))


def period_return(k: int, w: WindowSpec) -> Column:
    return F.try_divide(F.col("close"), F.lag("close", k).over(w)) - 1


def true_range(w: WindowSpec) -> Column:
    before = F.lag("close").over(w)
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def candle_shape() -> dict[str, Column]:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    body, span, upper, lower = F.abs(c - o), h - low, h - F.greatest(o, c), F.least(o, c) - low
    parts = {"body": body, "range": span, "upper_wick": upper, "lower_wick": lower}
    return parts | {f"{k}_ratio": guarded_ratio(v, span) for k, v in parts.items() if k != "range"}


#: Rows of a block of a series. After two blocks more, what came before weighs less than doubles can tell, for spans of up to 100.
BLOCK = 512


#: Rows before a block that its indicators look at: what lies further back weighs less in a mean than doubles can tell.
HALO = 4 * BLOCK


def with_ema(df: DataFrame, spans: tuple[int, ...] = SPANS, keys: tuple[str, ...] = SERIES, into: str = "ema_{}", start: Column | None = None) -> DataFrame:
    """df with the exponential mean of the close for each span, started at the series' first close. Closes must be known. Where keys
    name a part of a series, start is the place of its first row in the whole.

    The recursion is linear, so within a block a mean is a running sum of closes in falling weights, and a block hands the next
    ones its last sum, by the weight of the rows in between. That is one pass, whatever the span; the trailing blocks it looks
    at are as many as the span asks for.
    """
    w = series(keys)
    block = Window.partitionBy(*keys, "_part").orderBy("begin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumn("_i", F.row_number().over(w) - 1 + (F.lit(0) if start is None else start)).withColumns({"_part": F.floor(F.col("_i") / BLOCK), "_k": (F.col("_i") % BLOCK).cast("double")})
    sums, means = {}, {}
    for s in spans:
        a, q = 2 / (s + 1), 1 - 2 / (s + 1)
        weight = F.when(F.col("_i") == 0, 1.0).otherwise(a) * F.pow(F.lit(1 / q), F.col("_k"))
        sums[f"_own_{s}"] = F.sum(weight * F.col("close")).over(block) * F.pow(F.lit(q), F.col("_k"))
        carried, back = F.lit(0.0), 1
        while q ** (BLOCK * (back - 1)) > 1e-17:
            last = Window.partitionBy(*keys).orderBy("_part").rangeBetween(-back, -back)
            carried = carried + F.coalesce(F.sum(F.when(F.col("_k") == BLOCK - 1, F.col(f"_own_{s}"))).over(last), F.lit(0.0)) * q ** (BLOCK * (back - 1))
            back += 1
        means[into.format(s)] = F.col(f"_own_{s}") + carried * F.pow(F.lit(q), F.col("_k") + 1)
    return df.withColumns(sums).withColumns(means).drop("_i", "_part", "_k", *sums)


def with_indicators(df: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """All indicators of candles. Warm-up rows are null; with a split among the keys, each split warms up anew. Columns that begin with
    _ are not handed on.
    """
    df = in_blocks(df, keys, HALO, ROWS)
    keys = (*keys, "_block")
    w = series(keys)
    df = with_ema(df, SPANS, keys, "_ema_{}", F.col("_start")).withColumns({f"return_{k}": period_return(k, w) for k in RETURNS} | {"_tr": true_range(w)})
    tr, r1, vol = F.col("_tr"), F.col("return_1"), F.col("volume")
    df = df.withColumns(
        {
            "atr": full(F.avg(tr), tr, w.rowsBetween(1 - ATR, 0), ATR),
            "rolling_volatility": full(F.stddev_samp(r1), r1, w.rowsBetween(1 - VOLATILITY, 0), VOLATILITY),
            "volume_ratio": F.try_divide(vol, full(F.avg(vol), vol, w.rowsBetween(-VOLUME, -1), VOLUME)),
        }
    )
    df = df.withColumns(candle_shape() | {f"ema_{s}_distance": F.try_divide(F.col("close") - F.col(f"_ema_{s}"), F.col(f"_ema_{s}")) for s in SPANS} | calendar("begin"))
    others = [c for c in df.columns if c not in FEATURES and not c.startswith("_")]
    return df.where("_own").select(*others, *FEATURES)


def numeric_features(df: DataFrame, columns: tuple[str, ...] | None = None) -> list[str]:
    """The named columns, or all numbers that identify nothing, in the table's order."""
    from pyspark.sql.types import NumericType

    if columns is None:
        return [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in ("begin", "end", "ticker", "timeframe", "source")]
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"missing features: {missing}")
    return list(columns)
