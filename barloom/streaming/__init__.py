"""Candles as streams: bars, late copies, exponential means, outcomes and a decision log."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.clean import gated, with_defaults
from ..session import CANDLE_COLUMNS, CANDLES, stored
from ..sources.sinks import save_candles


def candle_stream(spark: SparkSession, path: str) -> DataFrame:
    """New files of a folder of candles. Watermarks want an instant: begin comes as a UTC timestamp."""
    df = spark.readStream.schema(CANDLES).parquet(path)
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ("begin", "end")})


def bar_stream(ticks: DataFrame, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of ticks (ticker, ts, price) in tumbling windows; a bar is final when the watermark has passed its end."""
    hour = F.window("ts", length)
    bars = ticks.withWatermark("ts", late).groupBy("ticker", hour).agg(
        F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.count("*").cast("double").alias("volume"), F.sum("price").alias("value")
    )
    return bars.select("ticker", F.col("window.start").alias("begin"), F.col("window.end").alias("end"), "open", "high", "low", "close", "volume", "value")


def first_candles(candles: DataFrame, late: str = "1 day") -> DataFrame:
    """Copies of a candle that come within the watermark are dropped."""
    return candles.withWatermark("begin", late).dropDuplicatesWithinWatermark(["ticker", "timeframe", "begin"])


def ema_stream(candles: DataFrame, span: int = 20) -> DataFrame:
    """(ticker, timeframe, begin, close, ema): the recursion goes on from batch to batch in the state of each series, which holds its
    last time and mean. Within a batch, candles are sorted; one that comes in a later batch than a candle after it is too late
    for the recursion: its mean is null and the state stays as it is.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("begin", kind="stable").reset_index(drop=True)
        last, mean = state.get if state.exists else (None, None)
        late = rows["begin"] < last if last is not None else pd.Series(False, rows.index)
        fresh = rows.loc[~late, "close"]
        means = pd.concat([pd.Series([] if mean is None else [mean], dtype=float), fresh]).ewm(span=span, adjust=False).mean()
        if len(fresh):
            state.update((rows["begin"].iloc[-1], float(means.iloc[-1])))
        yield rows[["ticker", "timeframe", "begin", "close"]].assign(ema=pd.Series(means.to_numpy()[len(means) - len(fresh) :], fresh.index).reindex(rows.index))

    rows = candles.select("ticker", "timeframe", "begin", "close")
    return rows.groupBy("ticker", "timeframe").applyInPandasWithState(step, "ticker string, timeframe string, begin timestamp, close double, ema double", "last timestamp, mean double", "append", GroupStateTimeout.NoTimeout)


def outcome_stream(predictions: DataFrame, candles: DataFrame, hours: int, late: str = "1 day") -> DataFrame:
    """Predictions (ticker, timestamp, prediction, close) joined with the candle `hours` later, when it comes."""
    p = predictions.withWatermark("timestamp", late).withColumn("due", F.col("timestamp") + F.make_dt_interval(hours=F.lit(hours)))
    c = candles.withWatermark("begin", late).select(F.col("ticker").alias("_t"), "begin", F.col("close").alias("later"))
    joined = p.join(c, F.expr("ticker = _t and begin = due"))
    return joined.select("ticker", "timestamp", "prediction", F.try_divide(F.col("later") - F.col("close"), F.col("close")).alias("actual_return"))


def append_log(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All there is, appended as JSON lines; then the query ends."""
    return df.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def store_stream(candles: DataFrame, path: str, rejects: str, checkpoint: str, batch: tuple[str, ...], row: str = "row") -> StreamingQuery:
    """All there is of a stream of batches, each stored as a whole or rejected as a whole; then the query ends.

    Candles of fit batches go to path; of each unfit one its keys, first violation, row and number of rows go to rejects. Both are
    written so that a micro-batch that is run again after a failure replaces what it wrote: candles by their series, first and last
    begin, rejects by the micro-batch's number. A batch must come within one micro-batch.
    """

    def store(rows: DataFrame, number: int) -> None:
        checked = stored(gated(with_defaults(rows), batch, row), "gated")
        save_candles(checked.where("rejected_rule is null").select(*CANDLE_COLUMNS), path)
        lost = checked.where("rejected_rule is not null").groupBy(*batch, "rejected_row", "rejected_rule").agg(F.count("*").alias("n"))
        lost.write.mode("overwrite").parquet(f"{rejects}/micro_batch={number}")

    return candles.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
