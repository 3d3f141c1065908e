"""Indicators and model windows of candles as a stream, from what is kept of each series."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions import calendar, no_nan
from ..operators.features import ATR, FEATURES, RETURNS, SPANS, VOLATILITY, VOLUME, candle_shape
from ..session import SERIES

#: Features that hang on the rows before; the others are those of a candle by itself.
OF_HISTORY = tuple(f"return_{k}" for k in RETURNS) + ("atr", "rolling_volatility", "volume_ratio") + tuple(f"ema_{s}_distance" for s in SPANS)
OF_CANDLE = tuple(c for c in FEATURES if c not in OF_HISTORY)
MEANS = tuple(f"mean_{s}" for s in SPANS)
CALENDAR = ("hour", "day_of_week", "month")
#: Rows before a candle that its own indicators look at, besides the means.
REACH = max(ATR, VOLATILITY, VOLUME, *RETURNS)


def windows_of(x: pd.Series, n: int, how) -> np.ndarray:
    """An aggregate over each n values up to a place; NaN before there are n, or where one is missing."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        out[n - 1 :] = how(np.lib.stride_tricks.sliding_window_view(x.to_numpy(), n))
    return out


def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return a / b.where(b != 0)


def history_features(rows: pd.DataFrame) -> pd.DataFrame:
    """rows (OF_CANDLE, MEANS; in order) with OF_HISTORY, by the definitions of `with_indicators`."""
    close, before = rows["close"], rows["close"].shift(1)
    reach = pd.concat([rows["high"] - rows["low"], (rows["high"] - before).abs(), (rows["low"] - before).abs()], axis=1).max(axis=1)
    one = ratio(close, before) - 1
    volume = pd.Series(windows_of(rows["volume"], VOLUME, lambda x: x.mean(axis=1)), rows.index).shift(1)
    found = {f"return_{k}": ratio(close, close.shift(k)) - 1 for k in RETURNS}
    found |= {"atr": windows_of(reach, ATR, lambda x: x.mean(axis=1)), "rolling_volatility": windows_of(one, VOLATILITY, lambda x: x.std(axis=1, ddof=1)), "volume_ratio": ratio(rows["volume"], volume)}
    found |= {f"ema_{s}_distance": ratio(close - rows[m], rows[m]) for s, m in zip(SPANS, MEANS, strict=True)}
    return rows.assign(**found)


def with_means(rows: pd.DataFrame, last: pd.DataFrame) -> pd.DataFrame:
    """rows with the exponential means of the close, which go on from the last known ones."""
    found = {}
    for s, m in zip(SPANS, MEANS, strict=True):
        start = list(last[m].iloc[-1:])
        found[m] = pd.Series([*start, *rows["close"]], dtype=float).ewm(span=s, adjust=False).mean().to_numpy()[len(start) :]
    return rows.assign(**found)


def feature_stream(candles: DataFrame, late: str = "1 day", length: int | None = None) -> DataFrame:
    """(ticker, timeframe, begin, FEATURES) of a stream of candles, each once and in order: what `with_indicators` gives for all candles
    at once. With a length also window, the last `length` rows of features, row after row; null while there are fewer.

    Candles may come in any order within the watermark, which trails the latest begin by `late`. They wait in their series' state
    until it has passed them; then they go through in order, and the state keeps the rows that indicators and windows look back at
    and the means so far. Its size is that of the waiting candles and some fifty rows. What comes after the watermark is dropped. Of
    copies of a waiting candle the one of the latest micro-batch stays, of copies within one the greatest close, then open, high,
    low, volume and value. Candles without a begin are dropped; closes must be known.
    """
    keep, names = REACH + (length or 1), [*OF_CANDLE, *MEANS]
    #: Missing values of a window travel as 0 that is not known: Spark's array functions cannot read nulls in Arrow's arrays.
    out = ["_at", *FEATURES] + (["_window", "_known"] if length else [])
    tie = ["_at", "close", "open", "high", "low", "volume", "value"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, tail, at, waiting = state.get if state.exists else (None, [], [], [])
        before = pd.DataFrame(np.array(tail, float).reshape(-1, len(names)), columns=names)
        held = pd.DataFrame(np.array(waiting, float).reshape(-1, len(OF_CANDLE)), columns=list(OF_CANDLE)).assign(_at=np.array(at, np.int64))
        came = [p[["_at", *OF_CANDLE]].astype(dict.fromkeys(OF_CANDLE, float)) for p in parts if len(p)]
        if came:
            held = pd.concat([held, pd.concat(came).sort_values(tie, kind="stable")], ignore_index=True)
            held = held.drop_duplicates("_at", keep="last").sort_values("_at", ignore_index=True)
        if last is not None:
            held = held[held["_at"] > last]
        mark = state.getCurrentWatermarkMs() * 1000
        ready, left = held[held["_at"] < mark], held[held["_at"] >= mark]
        if len(ready):
            rows = pd.concat([before, with_means(ready, before)], ignore_index=True)
            found = history_features(rows)
            if length:
                x = found[list(FEATURES)].to_numpy()
                there = ~np.isnan(x)
                for name, values in (("_window", np.where(there, x, 0.0)), ("_known", there)):
                    found[name] = [values[i + 1 - length : i + 1].ravel() if i + 1 >= length else None for i in range(len(x))]
            yield found.iloc[len(before) :][out].assign(**dict(zip(SERIES, key, strict=True)))[[*SERIES, *out]]
            last, before = int(ready["_at"].iloc[-1]), rows[names].iloc[-keep:]
        state.update((last, before.to_numpy().ravel().tolist(), left["_at"].tolist(), left[list(OF_CANDLE)].to_numpy().ravel().tolist()))
        if len(left):
            state.setTimeoutTimestamp(max(1, int(left["_at"].iloc[0]) // 1000))

    rows = candles.where("begin is not null").withWatermark("begin", late)
    rows = rows.withColumns(candle_shape() | calendar("begin")).select(*SERIES, "begin", F.unix_micros("begin").alias("_at"), *[F.col(c).cast("double") for c in OF_CANDLE])
    schema = "ticker string, timeframe string, _at long, " + ", ".join(f"{c} double" for c in FEATURES) + (", _window array<double>, _known array<boolean>" if length else "")
    state = "last long, tail array<double>, at array<long>, waiting array<double>"
    found = rows.groupBy(*SERIES).applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.EventTimeTimeout)
    features = [F.col(c).cast("int") if c in CALENDAR else no_nan(c).alias(c) for c in FEATURES]
    window = [F.zip_with("_window", "_known", lambda x, known: F.when(known, x)).alias("window")] if length else []
    return found.select(*SERIES, F.timestamp_micros("_at").alias("begin"), *features, *window)
