"""Blocks of series give what whole series give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from barloom.operators import blocks, evaluate, features, labels, split, windows
from barloom.session import SERIES


def candles(spark, n, seed=0, gaps=True):
    rng = np.random.default_rng(seed)
    rows = []
    for t, many in (("A", n), ("B", 7), ("C", 1)):
        at = np.cumsum(rng.choice([1, 1, 1, 20, 400], many) if gaps else np.ones(many, int))
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, many)))
        rows.append(pd.DataFrame({"ticker": t, "timeframe": "1H", "begin": pd.Timestamp("2020-01-01") + pd.to_timedelta(at, "h"), "open": close, "high": close * 1.01, "low": close * 0.99, "close": close * 1.001, "volume": rng.uniform(1, 9, many), "value": 1.0}))
    df = spark.createDataFrame(pd.concat(rows)).withColumn("begin", F.col("begin").cast("timestamp_ntz"))
    return df.repartition(5)


def test_places(spark):
    df = candles(spark, 400).union(candles(spark, 1).limit(1).withColumn("begin", F.lit(None).cast("timestamp_ntz")))
    w = Window.partitionBy(*SERIES).orderBy("begin")
    got = blocks.numbered(df, SERIES).where("begin is not null").withColumns({"i": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy(*SERIES))})
    assert got.where("_place <> i or _total <> n or _place is null").count() == 0 and got.count() == 408
    assert blocks.numbered(df, SERIES).where("_place is null").count() == 1


def test_indicators_by_blocks(spark, monkeypatch):
    """Blocks of 60 rows, halos of 40: the same indicators as in one block; means differ by what lies behind the halo."""
    df = candles(spark, 900)
    whole = features.with_indicators(df).toPandas().set_index(["ticker", "begin"]).sort_index()
    monkeypatch.setattr(features, "ROWS", 60)
    small = features.with_indicators(df).toPandas().set_index(["ticker", "begin"]).sort_index()
    pd.testing.assert_frame_equal(whole, small[whole.columns], rtol=1e-9, atol=1e-12)
    monkeypatch.setattr(features, "HALO", 40)
    near = features.with_indicators(df).toPandas().set_index(["ticker", "begin"]).sort_index()
    same = [c for c in whole.columns if not c.startswith("ema")]
    pd.testing.assert_frame_equal(whole[same], near[same], rtol=1e-9, atol=1e-12)
    assert len(near) == 908


def test_no_task_holds_a_series(spark):
    """One series of 300,000 rows: many tasks have rows, none more than a block and its halo; no exchange by series alone."""
    n, size = 300_000, blocks.ROWS // 4
    begin = F.expr("timestamp_ntz'1990-01-01'") + F.make_dt_interval(hours=F.col("id").cast("int"))
    df = spark.range(n).select(F.lit("A").alias("ticker"), F.lit("1H").alias("timeframe"), begin.alias("begin"), *[(100 + F.sin(F.col("id") / 50)).alias(c) for c in ("open", "high", "low", "close")], F.lit(1.0).alias("volume"), F.lit(1.0).alias("value"))
    rows = blocks.in_blocks(df, SERIES, features.HALO, size)
    sizes = rows.groupBy("_block").agg(F.count("*").alias("n"), F.count_if("_own").alias("own")).toPandas()
    assert sizes.own.sum() == n and len(sizes) == 19 and sizes.n.max() <= size + features.HALO + 48
    plan = features.with_indicators(df)._jdf.queryExecution().executedPlan().toString()
    parts = [x for x in plan.splitlines() if "Window" in x and "_block" in x]
    assert parts and split.time_split(df).groupBy("split").count().count() == 3


def test_curves_by_blocks(spark, monkeypatch):
    """Equity, drawdown and running sums are carried over blocks of 60 rows."""
    df = candles(spark, 500).withColumns({"signal": F.pmod(F.xxhash64("begin"), F.lit(3)).cast("int") - 1, "prediction": F.pmod(F.xxhash64("close"), F.lit(3)).cast("int"), "token": F.lit(1), "forward_return": F.col("high") / F.col("low") - 1.02})
    def found():
        curve = evaluate.backtest_curve(df, lag=2).toPandas().set_index(["ticker", "begin"]).sort_index()
        return curve, *[f.toPandas().set_index("ticker").sort_index() for f in (evaluate.trading_summary(df, 3), evaluate.simple_trading_metrics(df))]
    whole = found()
    monkeypatch.setattr(evaluate, "ROWS", 60)
    for a, b in zip(whole, found(), strict=True):
        pd.testing.assert_frame_equal(a, b[a.columns], rtol=1e-9, atol=1e-12)


def test_strict_outcomes(spark):
    """A prediction without a candle of its own is left out, or an error."""
    c = candles(spark, 30, gaps=False).select(*SERIES, "begin", "close")
    said = c.select(*SERIES, F.col("begin").alias("timestamp"), F.lit(1).alias("prediction"))
    n = evaluate.outcomes(said, c, 2).count()
    assert evaluate.outcomes(said, c, 2, strict=True).count() == n == 28 + 5
    lost = c.where("ticker <> 'A' or hour(begin) <> 7")
    assert evaluate.outcomes(said, lost, 2).count() < n
    with pytest.raises(Exception, match="no candle at"):
        evaluate.outcomes(said, lost, 2, strict=True).collect()


def test_windows_by_blocks(spark, monkeypatch):
    """Windows and contexts reach back over the ends of blocks."""
    df = candles(spark, 400).withColumn("token", F.pmod(F.xxhash64("begin"), F.lit(4)).cast("int") - F.when(F.hour("begin") == 3, 2).otherwise(0)).withColumn("token", F.greatest("token", F.lit(-1)))
    def found():
        made = (windows.sequence_windows(df, 12, ["close", "volume"]), windows.tabular_windows(df, 5, ["close"], token=None), windows.token_windows(df, 4, 3), windows.last_windows(df, 6, ["close"]))
        return [(sorted(m.columns), sorted(map(str, m.select(*sorted(m.columns)).collect()))) for m in made]
    whole = found()
    monkeypatch.setattr(windows, "ROWS", 50)
    assert found() == whole and [len(rows) for _, rows in whole][3] == 2


def test_forward_moves_by_blocks(spark, monkeypatch):
    """Moves and returns look into the rows after a block, over days with few rows too; the rows of a series' end have none."""
    df = candles(spark, 500).withColumns({"atr": F.col("high") - F.col("low"), "extra": F.col("volume")})
    horizons = {1: ("m1", "r1"), 30: ("m30", "r30")}
    w = Window.partitionBy(*SERIES).orderBy("begin")
    want = df.withColumns({m: labels.forward_move(h) for h, (m, _) in horizons.items()} | {x: labels.forward_return(h) for h, (_, x) in horizons.items()})
    want = want.withColumn("left", F.count("*").over(w.rowsBetween(1, Window.unboundedFollowing))).toPandas().set_index(["ticker", "begin"]).sort_index()
    monkeypatch.setattr(labels, "ROWS", 40)
    got = labels.with_forward(df, horizons)
    assert got.columns == [*df.columns, "m1", "m30", "r1", "r30"]
    pd.testing.assert_frame_equal(got.toPandas().set_index(["ticker", "begin"]).sort_index(), want[[c for c in got.columns if c not in ("ticker", "begin")]])
    assert (want.m30.isna() == (want.left < 30)).all()
    empty = labels.with_forward(df.limit(0), horizons)
    assert empty.count() == 0
    parts = blocks.dealt(df, SERIES, 0, 40, 30)[0]
    assert parts.where("_own").count() == 508 and parts.where("not _own").count() > 0
