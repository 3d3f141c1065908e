"""Operators on candles against numpy and pandas statements of the same formulas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from barloom.operators import clean as C
from barloom.operators import evaluate as E
from barloom.operators import features as W
from barloom.operators import labels as L
from barloom.operators import models as M
from barloom.operators import split as S
from barloom.operators import windows as V
from barloom.operators.quantiles import exact_quantiles
from barloom.plans import train as T
from barloom.session import CANDLES
from barloom.sources.files import mock_candles


@pytest.fixture(scope="module")
def candles(spark):
    return mock_candles(spark, 160).union(mock_candles(spark, 140, ticker="GAZP", seed=7)).cache()


@pytest.fixture(scope="module")
def frame(candles):
    return W.with_indicators(candles).toPandas().sort_values(["ticker", "begin"])


def test_indicators(candles, frame):
    for _, p in candles.toPandas().sort_values("begin").groupby("ticker"):
        got = frame[frame.ticker == p.ticker.iloc[0]]
        before = p.close.shift()
        tr = pd.concat([p.high - p.low, (p.high - before).abs(), (p.low - before).abs()], axis=1).max(axis=1)
        want = {
            "return_3": p.close.pct_change(3), "atr": tr.rolling(14).mean(), "rolling_volatility": p.close.pct_change().rolling(20).std(), "volume_ratio": p.volume / p.volume.shift().rolling(20).mean(),
            "day_of_week": p.begin.dt.dayofweek, "hour": p.begin.dt.hour,
        }
        for s in W.SPANS:
            e = p.close.ewm(span=s, adjust=False).mean()
            want[f"ema_{s}_distance"] = (p.close - e) / e
        for c, x in want.items():
            np.testing.assert_allclose(got[c].to_numpy(float), x.to_numpy(float), rtol=1e-9, atol=1e-12, err_msg=c)
    assert frame.atr.isna().sum() == 26 and [c for c in frame.columns if c in W.FEATURES] == list(W.FEATURES)


def test_no_look_ahead(spark, candles):
    cut = dt.datetime(2024, 1, 5)
    changed = candles.withColumn("close", F.when(F.col("begin") >= F.lit(cut), F.col("close") * 3).otherwise(F.col("close")))
    early = lambda d: W.with_indicators(d).where(F.col("begin") < F.lit(cut)).toPandas().sort_values(["ticker", "begin"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(early(candles), early(changed))


def test_ema_over_blocks(spark, candles):
    """Over many blocks, with spans for which one block back matters and for which none does, against the plain recursion."""
    rng = np.random.default_rng(3)
    n = 3 * W.BLOCK + 100
    rows = [("A" if i % 3 else "B", "1H", dt.datetime(2024, 1, 1) + dt.timedelta(hours=i), float(c)) for i, c in enumerate(100 + np.cumsum(rng.normal(0, 1, 3 * n)))]
    df = spark.createDataFrame(rows, "ticker string, timeframe string, begin timestamp_ntz, close double")
    got = W.with_ema(df, (2, 50, 400)).toPandas().sort_values(["ticker", "begin"])
    for span in (2, 50, 400):
        want = got.groupby("ticker").close.transform(lambda x: x.ewm(span=span, adjust=False).mean())
        assert np.abs(got[f"ema_{span}"] - want).max() < 1e-10 * want.abs().max()
    assert W.with_ema(df.limit(0)).count() == 0


def test_exact_quantiles(spark):
    """Ties, a value that a third of all rows have, nulls, an outlier, one value, none; coarse sketches leave more to count."""
    rng = np.random.default_rng(0)
    values = np.concatenate([rng.normal(0, 1, 2000), np.full(1000, 0.25), [1e12]])
    rows = [("a", float(x)) for x in values] + [("a", None)] * 50 + [("b", 3.0), ("c", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    shares = (0.0, 1 / 3, 0.5, 0.9, 1.0)
    for accuracy in (10, 10_000):
        got = {r["k"]: r for r in exact_quantiles(df, "v", shares, ("k",), accuracy).collect()}
        np.testing.assert_allclose(got["a"]["quantiles"], np.quantile(values, shares), rtol=1e-12)
        assert got["a"]["n"] == 3001 and got["b"]["quantiles"] == [3.0] * 5 and got["c"]["quantiles"] is None
    np.testing.assert_allclose(exact_quantiles(df, "v", shares).first()["quantiles"], np.quantile(np.append(values, 3.0), shares), rtol=1e-12)
    assert exact_quantiles(df.limit(0), "v", shares).first()["quantiles"] is None


def row(i, **x):
    begin = dt.datetime(2024, 1, 1, i)
    return {"ticker": "A", "timeframe": "1H", "begin": begin, "end": begin + dt.timedelta(hours=1), "open": 10.0, "high": 12.0, "low": 9.0, "close": 11.0, "volume": 5.0, "value": 55.0, "source": "t"} | x


def test_cleaning_cases(spark):
    bad = [row(0), row(1, high=8.0), row(2, open=-1.0), row(3, close=None), row(4, high=10.5), row(5, low=10.5), row(6, volume=0.0), row(7), row(7, close=10.0), row(9, close=float("nan"))]
    df = spark.createDataFrame([x | {"ingest": i} for i, x in enumerate(bad)], StructType([*CANDLES.fields, StructField("ingest", IntegerType())]))
    kept = C.clean_candles(df, order=("ingest",)).orderBy("begin").collect()
    assert [r["begin"].hour for r in kept] == [0, 6, 7] and kept[-1]["close"] == 10.0
    flagged = C.clean_candles(df.drop("ingest"), drop=False)
    assert flagged.where("invalid").count() == 4
    found = {r["begin"].hour: r["violations"] for r in C.batch_violations(df).collect()}
    assert found[1] == ["high below low"] and found[6] == ["volume not positive"] and "duplicate begin" in found[7]
    assert found[4] == [] and found[5] == []


def test_normalize_and_defaults(spark):
    df = spark.createDataFrame([(" ", 1.0)], "` Symbol` string, C double")
    assert C.normalize_columns(df).columns == ["ticker", "close"]
    with pytest.raises(ValueError):
        C.normalize_columns(spark.createDataFrame([(1, 2)], "c int, close int"))
    with pytest.raises(ValueError):
        C.missing_columns(df, strict=True)
    got = C.with_defaults(spark.createDataFrame([row(0, ticker=" ", end=None, value=0.0)], CANDLES)).first()
    assert got["ticker"] == "SBER" and got["end"] == dt.datetime(2024, 1, 1, 1) and got["value"] == 55.0


def test_split_sizes(spark):
    df = spark.range(24_613).select(F.lit("A").alias("ticker"), F.lit("1H").alias("timeframe"), (F.lit(dt.datetime(2020, 1, 1)) + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("begin"))
    assert {r["split"]: r["n"] for r in S.split_periods(S.time_split(df)).collect()} == {"train": 17_229, "val": 3_692, "test": 3_692}
    small = df.limit(1000)
    assert {r["split"]: r["n"] for r in S.split_periods(S.time_split(small)).collect()} == {"train": 1000}
    assert S.leaks(S.time_split(df)).count() == 0
    folds = S.walk_forward(df.where("begin < timestamp_ntz'2020-01-20'"), 3, 200, 100, 10).groupBy("fold", "part").count().collect()
    assert {(r["fold"], r["part"]): r["count"] for r in folds} == {(0, "train"): 200, (0, "test"): 100, (1, "train"): 300, (1, "test"): 100}
    with pytest.raises(ValueError):
        S.time_split(df, 0.5, 0.1, 0.1)


def test_tokens_like_numpy(spark, candles):
    f = W.with_indicators(candles).withColumn("move", L.forward_move(2))
    t = L.Tokenizer.fit(f, 5, 2)
    p = t.transform(f).toPandas()
    known = p.move.dropna().to_numpy()
    edges = np.quantile(known, np.linspace(0, 1, 6))
    np.testing.assert_allclose(t.edges, edges, rtol=1e-12)
    want = np.where(p.move.isna(), -1, np.clip(np.digitize(p.move.fillna(0), t.edges) - 1, 0, 4))
    assert (p.token == want).all()
    flat = L.fit_edges(spark.createDataFrame([(1.0,)] * 4, "move double"), 3).first()
    assert flat["edges"] == [1.0] * 4


def test_windows(candles):
    f = W.with_indicators(candles).withColumn("move", L.forward_move(1))
    f = L.Tokenizer.fit(f, 3).transform(f)
    w = V.tabular_windows(f, 4, ["close", "atr"]).where("ticker = 'SBER'").toPandas().sort_values("begin")
    p = f.where("ticker = 'SBER'").toPandas().sort_values("begin").reset_index(drop=True)
    at = p.index[p.begin == w.begin.iloc[3]][0]
    assert [x for x in w.window.iloc[3]][::2] == p.close[at - 3 : at + 1].tolist()
    c = V.token_windows(f, 3, 2).where("ticker = 'SBER'").toPandas().sort_values("begin")
    at = p.index[p.begin == c.begin.iloc[0]][0]
    assert list(c.context.iloc[0]) == p.token[at - 4 : at - 1].tolist()
    last = V.last_windows(f, 5, ["close"]).where("ticker = 'SBER'").first()
    assert [x[0] for x in last["window"]] == p.close[-5:].tolist()
    assert V.last_windows(f, 1000, ["close"]).count() == 0


def test_metrics_from_stored_confusion(spark):
    matrix = [[475, 384, 397], [301, 614, 315], [427, 368, 379]]
    cells = spark.createDataFrame([(i, j, n) for i, x in enumerate(matrix) for j, n in enumerate(x)], "actual int, predicted int, n long")
    got = E.class_metrics(cells).first()
    assert got["n"] == 3660 and abs(got["accuracy"] - 1468 / 3660) < 1e-12 and round(got["macro_f1"], 4) == 0.3980


def test_backtest_like_numpy(spark, candles):
    rng = np.random.default_rng(1)
    p = candles.where("ticker = 'SBER'").toPandas().sort_values("begin").reset_index(drop=True)
    p["prediction"] = rng.integers(0, 7, len(p))
    df = E.with_signals(spark.createDataFrame(p), 7)
    s = np.sign(p.prediction - 3)
    ret = np.append(0, np.diff(p.close) / p.close[:-1])
    traded = np.abs(np.diff(s, prepend=0))
    x = s * ret - traded * 0.0005
    equity = 1e5 * np.cumprod(1 + x)
    peak = np.maximum.accumulate(equity)
    got = E.backtest_summary(E.backtest_curve(df)).first()
    want = {"total_return": equity.iloc[-1] / 1e5 - 1, "sharpe_ratio": x.mean() / x.std(ddof=0), "max_drawdown": ((peak - equity) / peak).max(), "n_trades": (traded > 0).sum(), "win_rate": (x > 0).mean(), "hit_rate": (x[x != 0] > 0).mean()}
    for k, v in want.items():
        assert abs(got[k] - v) < 1e-9, k
    still = E.backtest_summary(E.backtest_curve(df.withColumn("signal", F.lit(0)))).first()
    assert still["sharpe_ratio"] == 0 and still["hit_rate"] == 0 and still["n_trades"] == 0


def test_outcomes(spark):
    c = spark.createDataFrame([row(0), row(1, close=22.0), row(2, close=5.5)], CANDLES)
    said = spark.createDataFrame([("A", "1H", dt.datetime(2024, 1, 1, 0), 4), ("A", "1H", dt.datetime(2024, 1, 1, 2), 1)], "ticker string, timeframe string, timestamp timestamp_ntz, prediction int")
    rep = E.online_report(E.outcomes(said, c, 1)).first()
    assert rep["n_predictions"] == 1 and rep["total_pnl"] == 1.0 and rep["accuracy"] == 0.0


def test_markov_and_majority(spark):
    rows = [([0, 1], 1), ([0, 1], 1), ([2, 1], 0), ([1, 2], 2), ([1, 2], -1)]
    df = spark.createDataFrame(rows, "context array<int>, token int")
    table, default = M.markov_table(df, 3, 1)
    got = {tuple(r["state"]): r["probabilities"] for r in table.collect()}
    assert got[(2,)] == [0, 0, 1] and [round(x, 3) for x in got[(1,)]] == [0.333, 0.667, 0]
    unseen = M.markov_predict(spark.createDataFrame([([0, 0], 1)], df.schema), table, default, 1).first()
    assert unseen["prediction"] == 1 and unseen["probabilities"] == [0.25, 0.5, 0.25]
    assert M.majority(df, 3).first()["prediction"] == 1


@pytest.mark.parametrize("kind", ["majority", "markov", "logistic", "boosted"])
def test_stored_models(spark, candles, tmp_path, kind):
    """Each kind is trained, stored, loaded and asked; predictions stay the same. Markov models have no features to answer from."""
    spec, out = T.Spec(kind, length=4, rounds=2, depth=2), f"file://{tmp_path}/m"
    metrics, model, tokenizer = T.train(candles, spec, out, least_train=60)
    assert {r["split"] for r in metrics.collect()} <= {"train", "val", "test"}
    assert L.Tokenizer.load(spark, f"{out}/tokenizer") == tokenizer
    frame, _ = T.features_and_tokens(candles, spec, 60)
    w = T.windows_for(frame, spec)
    again = M.load_model(spark, f"{out}/model").predict(w)
    order = ("ticker", "split", "begin")
    assert [r["probabilities"] for r in again.orderBy(*order).collect()] == [r["probabilities"] for r in model.predict(w).orderBy(*order).collect()]
    if kind == "markov":
        with pytest.raises(ValueError):
            T.infer_stored(candles, out)
        return
    answers = T.infer_stored(candles, out).collect()
    assert len(answers) == 2 and all(abs(sum(a["probabilities"]) - 1) < 1e-9 and a["action"] in ("buy", "sell", "hold") and a["model_version"] == "latest" for a in answers)


def test_training(spark, candles):
    with pytest.raises(ValueError):
        T.train(candles.limit(20), T.Spec())
    board = E.leaderboard(T.research(spark, candles, [T.Spec("majority", length=4), T.Spec("markov", length=4), T.Spec("rnn", length=4)], 60)).collect()
    assert len(board) == 2 and len(T.grid()) == 153


def test_grid_rounds():
    """The boosted cells have the reference grid's rounds, depths and rates."""
    assert {(s.rounds, s.depth, s.rate) for s in T.grid() if s.model == "boosted"} == {(160, 3, 0.04), (220, 4, 0.025)}


def test_grid_goes_on(spark, candles, tmp_path):
    """Cells in the ledger are not done again; those with an error are."""
    ledger, specs = f"file://{tmp_path}/ledger", [T.Spec("majority", length=4), T.Spec("markov", length=4), T.Spec("rnn", length=4), T.Spec("majority", n_classes=5, length=4), T.Spec("majority", n_classes=3, horizon=2, length=8)]
    first = T.research(spark, candles, specs[:3], 60, ledger).collect()
    assert [r["error"] is None for r in first] == [True, True, False] and spark.read.json(ledger).count() == 3
    rows = T.research(spark, candles, specs, 60, ledger).collect()
    assert rows[:2] == first[:2] and spark.read.json(ledger).count() == 6 and rows[3]["n_classes"] == 5 and rows[4]["error"] is None
    alone = T.research(spark, candles, specs[4:], 60).collect()
    assert alone == rows[4:]


def test_boosting_stops(spark):
    """Each class keeps the rounds up to its smallest loss on the validation split."""
    assert M.best_round([3, 2, 1, 2, 2, 0], 2) == 3 and M.best_round([3, 2, 1, 2, 2, 0], 3) == 6 and M.best_round([1.0], 10) == 1
    rng = np.random.default_rng(0)
    rows = [(s, [float(x), float(y)], int((x > 0) ^ (rng.random() < 0.4))) for s in ("train", "val") for x, y in rng.normal(size=(150, 2))]
    df = spark.createDataFrame(rows, "split string, window array<double>, token int").cache()
    train, val = df.where("split = 'train'"), df.where("split = 'val'")
    whole, cut = (M.Boosted.fit(train, 2, 2, 25, 3, 0.3, val=v) for v in (None, val))
    assert whole.rounds() == [25, 25] and all(0 < n < 25 for n in cut.rounds())
    loss = lambda m: -sum(np.log(r["probabilities"][r["token"]]) for r in m.predict(val).collect())
    assert loss(cut) < loss(whole)
    assert all(abs(sum(r["probabilities"]) - 1) < 1e-9 for r in cut.predict(val).collect())
