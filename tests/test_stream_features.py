"""Indicators and answers of streams against those of all candles at once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import no_nan
from barloom.operators.features import FEATURES, with_indicators
from barloom.operators.models import Logistic, Majority, Markov
from barloom.operators.windows import tabular_windows
from barloom.plans.train import infer_stream
from barloom.session import CANDLES
from barloom.streaming import candle_stream
from barloom.streaming.features import feature_stream

LATE = "6 hours"


def candles(n=90, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for t, many in (("A", n), ("B", 8)):
        close = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, many)))
        begin = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(many), "h")
        rows.append(pd.DataFrame({"ticker": t, "timeframe": "1H", "begin": begin, "end": begin + pd.Timedelta("1h"), "open": close * rng.uniform(0.99, 1.01, many), "high": close * 1.02, "low": close * 0.98, "close": close, "volume": rng.integers(0, 9, many).astype(float), "value": 1.0, "source": "x"}))
    return pd.concat(rows, ignore_index=True)


def frame(spark, rows):
    values = [no_nan(f.name).alias(f.name) if f.dataType.typeName() == "double" else F.col(f.name).cast(f.dataType) for f in CANDLES]
    return spark.createDataFrame(rows).select(*values)


class Run:
    """A stream over files that are added one after the other; each time the query starts from its checkpoint."""

    def __init__(self, spark, at, rows_of):
        self.spark, self.at, self.rows_of = spark, str(at), rows_of

    def add(self, rows):
        frame(self.spark, rows).coalesce(1).write.mode("append").parquet(f"{self.at}/in")
        out = self.rows_of(candle_stream(self.spark, f"{self.at}/in"))
        out.writeStream.format("parquet").option("path", f"{self.at}/out").option("checkpointLocation", f"{self.at}/state").trigger(availableNow=True).start().awaitTermination()
        self.schema = out.schema
        return self

    def found(self):
        return self.spark.read.schema(self.schema).parquet(f"{self.at}/out").withColumn("begin", F.col("begin").cast("timestamp_ntz"))


def sorted_pandas(df):
    return df.toPandas().set_index(["ticker", "begin"]).sort_index()


def test_out_of_order(spark, tmp_path):
    """Three runs with candles up to five hours late give each settled candle once, as all candles at once do; windows too."""
    rows = candles()
    place = rows.groupby("ticker").cumcount().to_numpy()
    part = np.minimum(place // 30 + ((place % 30 > 25) & (place % 2 == 0)), 2)
    run = Run(spark, tmp_path, lambda x: feature_stream(x, LATE, 4))
    for k in range(3):
        run.add(rows[part == k].sample(frac=1, random_state=k))
    got = sorted_pandas(run.found())
    whole = with_indicators(frame(spark, rows))
    want = sorted_pandas(whole.select("ticker", "begin", *FEATURES))
    want = want[want.index.get_level_values(1) < rows["begin"].max() - pd.Timedelta(LATE)]
    assert len(got) == len(want) == 83 + 8
    pd.testing.assert_frame_equal(got[list(FEATURES)], want[list(FEATURES)], rtol=1e-9, atol=1e-12, check_dtype=False)
    windows = sorted_pandas(tabular_windows(whole, 4, list(FEATURES), token=None).select("ticker", "begin", "window"))
    seen = got["window"].dropna()
    assert len(seen) == 83 + 8 - 6
    for at, x in seen.items():
        np.testing.assert_allclose(np.array(x, float), np.array(windows.loc[at, "window"], float), rtol=1e-9, atol=1e-12)


def test_copies_and_late_candles(spark, tmp_path):
    """Of copies that wait, the latest micro-batch's stays; within one, the greatest close. Late candles and ones without a begin go."""
    rows = candles(20)
    rows = rows[rows["ticker"] == "A"]
    same = rows.iloc[18:19]
    run = Run(spark, tmp_path, lambda x: feature_stream(x, LATE)).add(rows[rows.index != 3])
    run.add(pd.concat([rows.iloc[3:4], same.assign(close=7.0), same.assign(close=6.0), same.assign(begin=pd.NaT)]))
    run.add(rows.iloc[-1:].assign(begin=rows["begin"].max() + pd.Timedelta("2d")))
    got = sorted_pandas(run.found()).reset_index()
    assert len(got) == 19 and got["begin"].is_unique
    assert rows["begin"].iloc[3] not in set(got["begin"])
    assert got.set_index("begin").loc[same["begin"].iloc[0], "close"] == 7.0


def test_missing_and_zero_values(spark, tmp_path):
    """Volumes that are missing or 0, flat candles and a close of 0 give nulls and zeros as for all candles at once."""
    rows = candles(60)
    rows.loc[5, "volume"] = np.nan
    rows.loc[30:55, "volume"] = 0.0
    rows.loc[10, ["open", "high", "low", "close"]] = 0.0
    rows.loc[12, ["open", "high", "low"]] = rows.loc[12, "close"]
    early = rows["begin"] < rows["begin"].min() + pd.Timedelta("33h")
    got = sorted_pandas(Run(spark, tmp_path, lambda x: feature_stream(x, LATE)).add(rows[early]).add(rows[~early]).found())
    want = sorted_pandas(with_indicators(frame(spark, rows)).select("ticker", "begin", *FEATURES)).loc[got.index]
    assert len(got) == 53 + 8
    pd.testing.assert_frame_equal(got[list(FEATURES)], want[list(FEATURES)], rtol=1e-9, atol=1e-12, check_dtype=False)


def test_answers(spark, tmp_path):
    run = Run(spark, tmp_path, lambda x: infer_stream(x, Majority(2, [0.2, 0.3, 0.5], 3), 3, 5, LATE, "v1").withColumnRenamed("timestamp", "begin"))
    got = run.add(candles(30)).found().collect()
    assert len(got) == 23 + 8 - 8 and {(r["predicted_token"], r["action"], r["confidence"], r["model_version"]) for r in got} == {(2, "buy", 0.5, "v1")}
    with pytest.raises(ValueError, match="Markov"):
        infer_stream(candle_stream(spark, f"{tmp_path}/in"), Markov(None, [], 1, 3), 3)


def test_answers_of_a_fitted_model(spark, tmp_path):
    """Windows from state, with missing values in them, are scored as windows of all candles at once."""
    whole = with_indicators(frame(spark, candles())).withColumn("token", F.pmod(F.hour("begin"), F.lit(3)))
    windows = tabular_windows(whole, 4, list(FEATURES)).select("ticker", "begin", "window", "token")
    model = Logistic.fit(windows, 3, 4 * len(FEATURES), max_iter=5)
    run = Run(spark, tmp_path, lambda x: infer_stream(x, model, 3, 4, LATE).withColumnRenamed("timestamp", "begin"))
    got = sorted_pandas(run.add(candles()).found())
    want = sorted_pandas(model.predict(windows)).loc[got.index]
    assert len(got) == 83 + 8 - 6
    np.testing.assert_allclose(np.array(list(got["probabilities"])), np.array(list(want["probabilities"])), rtol=1e-6, atol=1e-9)
