"""Decisions, sources, sinks, configuration and streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from barloom import functions as X
from barloom.operators import decide as Q
from barloom.plans import routes
from barloom.session import CANDLES
from barloom.sources import blocks, config, files, rest, sinks
from barloom.streaming import append_log, bar_stream, candle_stream, ema_stream, first_candles, outcome_stream

REQUEST = "probabilities array<double>, action string, confidence double, last_close double, rsi double, macd_line double, macd_signal double, ema_20 double, ema_50 double, volume_ratio double, support_levels array<double>, resistance_levels array<double>, news array<struct<title: string, summary: string>>, position double, exposure double, day_pnl double, max_position double, max_exposure double, max_daily_loss double"
PLAIN = dict(probabilities=[0.1, 0.1, 0.8], action="buy", confidence=0.9, last_close=100.0, rsi=0.0, macd_line=1.0, macd_signal=0.0, ema_20=2.0, ema_50=1.0, volume_ratio=1.0, support_levels=[], resistance_levels=[], news=[], position=0.0, exposure=0.0, day_pnl=0.0, max_position=0.0, max_exposure=0.0, max_daily_loss=0.0)


def decide(spark, cfg=Q.DecisionConfig(), **x):
    return Q.evaluate_decisions(spark.createDataFrame([PLAIN | x], REQUEST), cfg).first()


def test_decisions(spark):
    buy = decide(spark)
    assert buy["action"] == "BUY" and buy["llm_strength"] == 0.5 and buy["llm_confidence"] == 0.5 and abs(buy["score"] - (0.6 * 0.7 * 0.9 + 0.4 * 0.25)) < 1e-12
    assert buy["recommended_size"] == 50 and buy["resulting_position"] == 50
    flag = decide(spark, volume_ratio=2.5)
    assert flag["action"] == "HOLD" and flag["reason"] == "llm_risk_flag_override" and flag["risk_flags"] == ["volume_spike"]
    failed = decide(spark, confidence=None)
    assert failed["action"] == "HOLD" and failed["fallbacks"] == ["ml_hold_fallback"] and failed["score"] == 0
    short = decide(spark, probabilities=[0.9, 0.1, 0.0], macd_line=-1.0, ema_20=0.0)
    assert short["action"] == "HOLD" and short["blocking_reasons"] == ["short selling is disabled", "no available position size after limits"] and short["score"] < -0.25
    loss = decide(spark, day_pnl=-1000.0)
    assert loss["reason"] == "risk_manager_block" and loss["blocking_reasons"] == ["daily loss limit exceeded"]
    news = decide(spark, news=[("A BEAT", ""), ("суд", ""), ("beat and halt", "")])
    assert news["risk_flags"] == ["negative_news"] and abs(news["llm_strength"] - 0.65) < 1e-9 and len(news["key_factors"]) == 5
    capped = decide(spark, Q.DecisionConfig(base_size=30.0), position=-90.0)
    assert capped["recommended_size"] == 10


def test_scalars(spark):
    p = [0.14285714285714285 * x for x in (1, 1, 1, 1, 1, 1, 1)]
    one = spark.createDataFrame([(p, [1.0, 3.0, 5.0], [0.2, 0.4, 0.4])], "p array<double>, l array<double>, q array<double>")
    got = one.select(X.expected_position("p").alias("e"), X.nearest("l", F.lit(4.0), True).alias("s"), X.nearest("l", F.lit(4.0), False).alias("r"), X.nearest("l", F.lit(0.0), False).alias("z"), X.argmax("q").alias("a"), X.class_action(F.lit(2), 4).alias("c"), X.error_message(F.lit('{"error": "x"}')).alias("m")).first()
    assert abs(got["e"]) < 1e-12 and (got["s"], got["r"], got["z"], got["a"], got["c"], got["m"]) == (3.0, 5.0, None, 1, "hold", "x")


def test_paged_source(spark, tmp_path):
    cols = ["end", "begin", "open", "close", "high", "low", "value", "volume"]
    data = [[f"2024-01-01 {i:02}:59:59", f"2024-01-01 {i:02}:00:00", "1.5", 2, 3, 1, None, 7] for i in range(5)]
    for start in (0, 2, 4):
        (tmp_path / f"A_{start}.json").write_text(json.dumps({"candles": {"columns": cols, "data": data[start : start + 2]}}))
    (tmp_path / "B_0.json").write_text(json.dumps({"candles": {"columns": cols, "data": []}}))
    got = routes.fetch_candles(spark, f"file:{tmp_path}", ["A", "B"], "1H", "2024-01-01", "2024-01-02", page="2").orderBy("begin").collect()
    assert [r["begin"].hour for r in got] == [0, 1, 2, 3, 4] and got[0]["open"] == 1.5 and got[0]["value"] == 0
    lacking = spark.createDataFrame([(json.dumps({"candles": {"columns": cols[1:], "data": []}}),)], "json string")
    with pytest.raises(Exception, match="lacks column end"):
        blocks.decode_blocks(lacking).collect()
    reader = rest.PagedReader({"url": "https://h", "timeframe": "1D", "from": "2024-01-01T00:00", "till": "2024-02-01"})
    assert reader.url("S", 500) == "https://h/iss/engines/stock/markets/shares/boards/TQBR/securities/S/candles.json?interval=24&from=2024-01-01&till=2024-02-01&start=500"
    assert rest.headers({"token": "t"})["Authorization"] == "Bearer t" and rest.headers({"user": "u"})["Authorization"].startswith("Basic ")
    for bad in ("/other/x", "/iss/x.xml"):
        with pytest.raises(ValueError):
            rest.json_path(bad)
    assert rest.resource_path("hi2", "S") == "/iss/datashop/algopack/eq/hi2/S.json"


def test_files(spark, tmp_path):
    c = files.mock_candles(spark, 30)
    summary = routes.store_candles(c, str(tmp_path / "raw")).first()
    assert summary["n"] == 30
    c.toPandas().to_parquet(tmp_path / "x.parquet")
    back = files.load_candles(spark, str(tmp_path / "x.parquet"), ticker="SBER")
    assert back.count() == 30 and back.agg(F.min("begin")).first()[0] == dt.datetime(2024, 1, 1)
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.csv").write_text("Date,O,H,L,C,Vol\n2024-01-01,1,2,0.5,1.5,10\n")
    assert files.load_candles(spark, str(tmp_path / "d")).first()["close"] == 1.5
    with pytest.raises(ValueError):
        files.load_candles(spark, str(tmp_path / "x.parquet"), ticker="NONE")
    with pytest.raises(ValueError, match="duplicate begin"):
        routes.prepare(c.union(c))
    sinks.append_decisions(c.limit(2), str(tmp_path / "log"))
    sinks.save_report(c.limit(1), str(tmp_path / "r/report.json"))
    assert files.read_json_document(str(tmp_path / "r/report.json"))["ticker"] == "SBER"
    probs = sinks.probability_columns(spark.createDataFrame([([0.5, 0.5],)], "probabilities array<double>"), 2)
    assert probs.columns == ["prob_class_0", "prob_class_1"]


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("raw_dir: raw\nsource:\n  page: 100\n")
    pytest.importorskip("yaml")
    cfg = config.service_config(str(tmp_path / "c.yaml"), {"BARLOOM_SOURCE_TIMEOUT": "3"})
    assert cfg.source.page == 100 and cfg.source.timeout == 3 and cfg.raw_dir == str(tmp_path / "raw")
    with pytest.raises(ValueError):
        config.service_config(env={"BARLOOM_SOURCE_PAGE": "0"})


def test_wire(spark):
    j = spark.createDataFrame([('{"begin": "2024-01-01T10:00:00+03:00", "end": "", "close": 1}',)], "j string")
    c = j.select(blocks.decode_candle("j").alias("c")).first()["c"]
    assert c["begin"] == dt.datetime(2024, 1, 1, 7) and c["end"] is None


def run(query, name):
    q = query.writeStream.format("memory").queryName(name).outputMode("append").start()
    q.processAllAvailable()
    q.stop()


def test_streams(spark, tmp_path):
    c = files.mock_candles(spark, 40)
    c.where("begin < timestamp_ntz'2024-01-02'").coalesce(1).write.parquet(str(tmp_path / "in"))
    run(ema_stream(candle_stream(spark, str(tmp_path / "in"))), "ema")
    got = spark.table("ema").toPandas().sort_values("begin")
    want = c.toPandas().close[:24].ewm(span=20, adjust=False).mean()
    assert abs(got.ema.to_numpy() - want.to_numpy()).max() < 1e-9
    c.where("begin < timestamp_ntz'2024-01-02'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run(first_candles(candle_stream(spark, str(tmp_path / "in"))), "firsts")
    assert spark.table("firsts").count() == 24
    ticks = candle_stream(spark, str(tmp_path / "in")).select("ticker", F.col("begin").alias("ts"), F.col("close").alias("price"))
    run(bar_stream(ticks, "4 hours"), "bars")
    assert spark.table("bars").count() == 5
    s = candle_stream(spark, str(tmp_path / "in"))
    said = s.select("ticker", F.col("begin").alias("timestamp"), F.lit(1).alias("prediction"), "close")
    run(outcome_stream(said, candle_stream(spark, str(tmp_path / "in")), 2), "outs")
    assert spark.table("outs").count() == 4 * 22
    append_log(s, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.json(str(tmp_path / "out")).count() == 48
