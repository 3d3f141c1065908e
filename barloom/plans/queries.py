"""The engine's queries on the test tables, each with the same in DuckDB's SQL where SQL can say it.

Numbers are rounded on both sides, since results are compared by hash; counts are longs and times are without a zone.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import functions as X
from .. import streaming as ST
from ..operators import clean as C
from ..operators import decide as Q
from ..operators import evaluate as E
from ..operators import features as W
from ..operators import labels as L
from ..operators import models as M
from ..operators import split as S
from ..operators import windows as V
from ..session import CANDLE_COLUMNS, PRICES, SERIES, scratch, stored
from ..sources import blocks as B
from ..sources.files import bars_daily, bars_hourly, load_candles, load_predictions, stored_candles, union_by_name
from ..sources.sinks import append_predictions, probability_columns, save_candles, save_pages, write_csv
from ..streaming.features import feature_stream
from . import routes as R
from . import train as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        name = f.__name__.removeprefix("q_")
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def r(x: str | Column, digits: int = 6, name: str | None = None) -> Column:
    """Rounded, without negative zeros."""
    name = name or (x if isinstance(x, str) else None)
    out = F.round(x, digits) + F.lit(0.0)
    return out.alias(name) if name else out


def rr(x: str, digits: int = 6, name: str | None = None) -> str:
    return f"round({x}, {digits}) + 0.0 AS {name or x}"


BARS = """bars AS (SELECT event_type AS ticker, '1H' AS timeframe, date_trunc('hour', ts) AS "begin", date_trunc('hour', ts) + INTERVAL 1 HOUR AS "end",
 arg_min(value, ts) AS open, max(value) AS high, min(value) AS low, arg_max(value, ts) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(value) AS value, 'events' AS source
 FROM events GROUP BY event_type, date_trunc('hour', ts))"""
DAYS = """bars AS (SELECT o_orderpriority AS ticker, '1D' AS timeframe, CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS "begin", CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) + INTERVAL 1 DAY AS "end",
 arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high, min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume, sum(o_totalprice) AS value, 'orders' AS source
 FROM orders GROUP BY o_orderpriority, date_trunc('day', o_orderdate))"""
INVALID = "coalesce(high < low, false) OR coalesce(open <= 0 OR high <= 0 OR low <= 0 OR close <= 0, false) OR coalesce(high < greatest(open, close), false) OR coalesce(low > least(open, close), false)"
GOOD = f"c AS (SELECT * FROM bars WHERE NOT ({INVALID}) AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL AND volume IS NOT NULL)"
OWN = 'PARTITION BY ticker, timeframe ORDER BY "begin"'
SO_FAR = f"({OWN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def indicators_sql(keys: str = "ticker, timeframe", source: str = "c") -> str:
    own = f'PARTITION BY {keys} ORDER BY "begin"'
    ema = ", ".join(f"list_reduce(list(close) OVER ({own} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), lambda a, x: a + {2 / (s + 1)!r} * (x - a)) AS ema_{s}" for s in W.SPANS)
    ret = ", ".join(f"close / nullif(lag(close, {k}) OVER ({own}), 0) - 1 AS return_{k}" for k in W.RETURNS)
    span = "CASE WHEN high - low > 0 THEN {} / (high - low) ELSE 0 END"
    shape = {"body": "abs(close - open)", "upper_wick": "high - greatest(open, close)", "lower_wick": "least(open, close) - low"}
    shapes = ", ".join(f"{v} AS {k}, {span.format('(' + v + ')')} AS {k}_ratio" for k, v in shape.items())
    dist = ", ".join(f"(close - ema_{s}) / nullif(ema_{s}, 0) AS ema_{s}_distance" for s in W.SPANS)
    return f"""i0 AS (SELECT *, {ret}, greatest(high - low, abs(high - lag(close) OVER ({own})), abs(low - lag(close) OVER ({own}))) AS tr, {ema} FROM {source}),
ind AS (SELECT *, CASE WHEN count(tr) OVER a = 14 THEN avg(tr) OVER a END AS atr, CASE WHEN count(return_1) OVER b = 20 THEN stddev_samp(return_1) OVER b END AS rolling_volatility,
 volume / nullif(CASE WHEN count(volume) OVER p = 20 THEN avg(volume) OVER p END, 0) AS volume_ratio, {shapes}, high - low AS "range", {dist},
 CAST(hour("begin") AS INT) AS "hour", CAST(isodow("begin") - 1 AS INT) AS day_of_week, CAST(month("begin") AS INT) AS "month"
 FROM i0 WINDOW a AS ({own} ROWS BETWEEN 13 PRECEDING AND CURRENT ROW), b AS ({own} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), p AS ({own} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))"""


def hourly(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_candles(bars_hourly(spark, d))


def daily(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_candles(bars_daily(spark, d))


IDS = ("ticker", "begin")
SQL_IDS = 'ticker, "begin"'
BAR_OUT = ("ticker", "timeframe", "begin", "end", "open", "high", "low", "close", "volume")
SQL_BAR_OUT = 'ticker, timeframe, "begin", "end", open, high, low, close, volume'


# Sources, names, defaults -------------------------------------------------------------------------------------------


@query(f"WITH {BARS} SELECT {SQL_BAR_OUT}, {rr('value', 2)}, source FROM bars")
def q_bars_hourly(spark: SparkSession, d: str) -> DataFrame:
    return bars_hourly(spark, d).select(*BAR_OUT, r("value", 2), "source")


@query(f"WITH {DAYS} SELECT {SQL_BAR_OUT}, {rr('value', 2)}, source FROM bars")
def q_bars_daily(spark: SparkSession, d: str) -> DataFrame:
    return bars_daily(spark, d).select(*BAR_OUT, r("value", 2), "source")


@query(f"WITH {BARS} SELECT {SQL_BAR_OUT} FROM bars")
def q_normalize_columns(spark: SparkSession, d: str) -> DataFrame:
    odd = bars_hourly(spark, d).select(F.col("ticker").alias(" Symbol"), F.col("timeframe").alias("TF "), F.col("begin").alias("Timestamp"), F.col("end").alias("END"), F.col("open").alias("O"), F.col("high").alias("H"), F.col("low").alias("l"), F.col("close").alias("C"), F.col("volume").alias("Vol"))
    return C.normalize_columns(odd).select(*BAR_OUT)


@query(f"""WITH {BARS} SELECT CASE WHEN hour("begin") % 5 = 0 THEN 'SBER' ELSE ticker END AS ticker, timeframe, "begin", "end", CASE WHEN hour("begin") % 3 = 0 THEN 'unknown' ELSE source END AS source,
 round(CASE WHEN hour("begin") % 2 = 0 OR value = 0 THEN close * volume ELSE value END, 2) + 0.0 AS value FROM bars""")
def q_candle_defaults(spark: SparkSession, d: str) -> DataFrame:
    h = F.hour("begin")
    blank = bars_hourly(spark, d).withColumns({"ticker": F.when(h % 5 == 0, " ").otherwise(F.col("ticker")), "source": F.when(h % 3 != 0, F.col("source")), "value": F.when(h % 2 == 0, 0.0).otherwise(F.col("value")), "end": F.when(h % 4 != 0, F.col("end"))})
    return C.with_defaults(blank).select("ticker", "timeframe", "begin", "end", "source", r("value", 2))


#: Texts that bars are given by their hour.
TIMEFRAMES = ("15M", "1h", " 2D ", "0H", "1W", "", "10m")


def by_hour(values: tuple, every: int | None = None) -> Column:
    """One of some values, columns or constants, by a bar's hour."""
    as_column = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = F.when(F.hour("begin") % len(values) == 0, as_column(values[0]))
    for k, v in enumerate(values[1:], 1):
        out = out.when(F.hour("begin") % len(values) == k, as_column(v))
    return out


def hour_sql(*values: str) -> str:
    return f"CASE hour(\"begin\") % {len(values)} " + " ".join(f"WHEN {k} THEN {v}" for k, v in enumerate(values)) + " END"


@query(f"""WITH {BARS} SELECT {SQL_IDS}, {hour_sql(*[f"'{t}'" for t in TIMEFRAMES])} AS timeframe, {hour_sql('"begin" + INTERVAL 15 MINUTE', '"begin" + INTERVAL 1 HOUR', '"begin" + INTERVAL 2 DAY', 'NULL', 'NULL', 'NULL', '"begin" + INTERVAL 10 MINUTE')} AS "end",
 CAST({hour_sql('NULL', '60', 'NULL', 'NULL', 'NULL', 'NULL', '10')} AS INT) AS code FROM bars""")
def q_timeframes(spark: SparkSession, d: str) -> DataFrame:
    rows = bars_hourly(spark, d).withColumn("timeframe", by_hour(TIMEFRAMES))
    return rows.select(*IDS, "timeframe", (F.col("begin") + X.timeframe_interval("timeframe")).alias("end"), X.interval_code("timeframe").alias("code"))


@query(f"""WITH {BARS}, b2 AS (SELECT ticker, "begin", close, 0 AS extra FROM bars UNION ALL SELECT ticker, "begin", close, 1 FROM bars WHERE hour("begin") < 6) SELECT ticker, count(*) AS n, CAST(sum(extra) AS BIGINT) AS extra FROM b2 GROUP BY ticker""")
def q_union_by_name(spark: SparkSession, d: str) -> DataFrame:
    b = bars_hourly(spark, d)
    both = union_by_name([b.select("ticker", "begin", "close"), b.where(F.hour("begin") < 6).select("close", "begin", "ticker", F.lit(1).alias("extra"))])
    return both.groupBy("ticker").agg(F.count("*").alias("n"), F.sum(F.coalesce("extra", F.lit(0))).alias("extra"))


# Cleaning -----------------------------------------------------------------------------------------------------------

TWICE = f"""{BARS}, twice AS (SELECT *, 0 AS ingest FROM bars UNION ALL SELECT ticker, timeframe, "begin", "end", open, high, low, close * 1.25, volume, value, source, 1 FROM bars WHERE hour("begin") < 12)"""
FAULTY = f"""{BARS}, faulty AS (SELECT ticker, timeframe, "begin", CASE WHEN hour("begin") = 9 THEN "end" + INTERVAL 2 HOUR ELSE "end" END AS "end", CASE WHEN hour("begin") = 1 THEN -open ELSE open END AS open,
 CASE WHEN hour("begin") = 2 THEN low - 1 ELSE high END AS high, CASE WHEN hour("begin") = 3 THEN greatest(open, close) + 1 ELSE low END AS low, CASE WHEN hour("begin") = 4 THEN NULL ELSE close END AS close,
 CASE WHEN hour("begin") = 5 THEN 0 ELSE volume END AS volume, value, source FROM bars)"""


def twice(spark: SparkSession, d: str) -> DataFrame:
    b = bars_hourly(spark, d)
    return b.withColumn("ingest", F.lit(0)).union(b.where(F.hour("begin") < 12).withColumn("close", F.col("close") * 1.25).withColumn("ingest", F.lit(1)))


def faulty(spark: SparkSession, d: str) -> DataFrame:
    h, c = F.hour("begin"), F.col
    return bars_hourly(spark, d).select(
        "ticker", "timeframe", "begin", F.when(h == 9, c("end") + F.expr("interval 2 hours")).otherwise(c("end")).alias("end"), F.when(h == 1, -c("open")).otherwise(c("open")).alias("open"), F.when(h == 2, c("low") - 1).otherwise(c("high")).alias("high"),
        F.when(h == 3, F.greatest("open", "close") + 1).otherwise(c("low")).alias("low"), F.when(h != 4, c("close")).alias("close"), F.when(h == 5, 0.0).otherwise(c("volume")).alias("volume"), "value", "source",
    )


@query(f"""WITH {TWICE} SELECT {SQL_IDS}, {rr('close', 4)}, ingest FROM twice QUALIFY row_number() OVER (PARTITION BY ticker, timeframe, "begin" ORDER BY ingest DESC) = 1""")
def q_dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return C.dedup_keep_last(twice(spark, d)).select(*IDS, r("close", 4), "ingest")


@query(f"WITH {FAULTY} SELECT {SQL_IDS}, {INVALID} AS invalid FROM faulty")
def q_invalid_flags(spark: SparkSession, d: str) -> DataFrame:
    return faulty(spark, d).select(*IDS, C.invalid().alias("invalid"))


@query(f"""WITH {FAULTY} SELECT ticker, count(*) FILTER (WHERE high < low) AS high_below_low, count(*) FILTER (WHERE open <= 0 OR high <= 0 OR low <= 0 OR close <= 0) AS not_positive,
 count(*) FILTER (WHERE high < greatest(open, close)) AS high_below_body, count(*) FILTER (WHERE low > least(open, close)) AS low_above_body, count(*) FILTER (WHERE {INVALID}) AS invalid, count(*) AS n FROM faulty GROUP BY ticker""")
def q_invalid_rule_counts(spark: SparkSession, d: str) -> DataFrame:
    return C.invalid_counts(faulty(spark, d), ("ticker",))


@query(f"WITH {FAULTY} SELECT {SQL_IDS}, close FROM faulty WHERE close IS NOT NULL AND open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND volume IS NOT NULL")
def q_drop_missing(spark: SparkSession, d: str) -> DataFrame:
    return C.drop_missing(faulty(spark, d)).select(*IDS, "close")


@query(f"""WITH {TWICE}, last AS (SELECT * FROM twice QUALIFY row_number() OVER (PARTITION BY ticker, timeframe, "begin" ORDER BY ingest DESC) = 1) SELECT {SQL_IDS}, open, high, low, {rr('close', 4)}, volume FROM last WHERE NOT ({INVALID})""")
def q_clean_candles(spark: SparkSession, d: str) -> DataFrame:
    return C.clean_candles(twice(spark, d), order=("ingest",)).select(*IDS, "open", "high", "low", r("close", 4), "volume")


@query(f"""WITH {FAULTY} SELECT {SQL_IDS}, concat_ws('; ', CASE WHEN "begin" IS NULL THEN 'no begin' END, CASE WHEN least(open, high, low, close) <= 0 THEN 'price not positive' END, CASE WHEN high < low THEN 'high below low' END,
 CASE WHEN volume <= 0 THEN 'volume not positive' END, CASE WHEN count(*) OVER (PARTITION BY ticker, timeframe, date_trunc('second', "begin")) > 1 THEN 'duplicate begin' END, CASE WHEN lag("end") OVER ({OWN}) > "begin" THEN 'overlaps the candle before' END) AS violations FROM faulty""")
def q_batch_violations(spark: SparkSession, d: str) -> DataFrame:
    return C.batch_violations(faulty(spark, d)).select(*IDS, F.array_join("violations", "; ").alias("violations"))


@query(f"""WITH {BARS} SELECT ticker, timeframe, count(*) AS n, min("begin") AS first_begin, arg_max("end", "begin") AS last_end, arg_min(source, "begin") AS source FROM bars GROUP BY ticker, timeframe""")
def q_batch_summary(spark: SparkSession, d: str) -> DataFrame:
    return C.batch_summary(bars_hourly(spark, d))


# Indicators ---------------------------------------------------------------------------------------------------------

IND = f"WITH {BARS}, {GOOD}, {indicators_sql()}"


def indicators(spark: SparkSession, d: str) -> DataFrame:
    return W.with_indicators(hourly(spark, d))


def indicator_query(name: str, columns: tuple[str, ...]) -> None:
    QUERIES[name] = lambda spark, d: indicators(spark, d).select(*IDS, *[r(c) for c in columns])
    ORACLE_SQL[name] = f"{IND} SELECT {SQL_IDS}, {', '.join(rr(c) for c in columns)} FROM ind"


indicator_query("returns_multi", ("return_1", "return_3", "return_5"))
indicator_query("atr14", ("atr",))
indicator_query("rolling_vol20", ("rolling_volatility",))
indicator_query("volume_ratio20", ("volume_ratio",))
indicator_query("ema_distance", tuple(f"ema_{s}_distance" for s in W.SPANS))
indicator_query("candle_shape", ("body", "upper_wick", "lower_wick", "body_ratio", "upper_wick_ratio", "lower_wick_ratio"))


@query(f"{IND} SELECT {SQL_IDS}, {rr('tr', 6, 'true_range')} FROM ind")
def q_true_range(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).withColumn("true_range", W.true_range(W.series())).select(*IDS, r("true_range"))


def ema_query(span: int) -> None:
    QUERIES[f"ema_{span}"] = lambda spark, d: W.with_ema(hourly(spark, d), (span,)).select(*IDS, r(f"ema_{span}", 6, "ema"))
    ORACLE_SQL[f"ema_{span}"] = f"{IND} SELECT {SQL_IDS}, {rr(f'ema_{span}', 6, 'ema')} FROM ind"


for _span in W.SPANS:
    ema_query(_span)


@query(f'{IND} SELECT {SQL_IDS}, "hour", day_of_week, "month" FROM ind')
def q_time_features(spark: SparkSession, d: str) -> DataFrame:
    return hourly(spark, d).select(*IDS, *[v.alias(k) for k, v in X.calendar("begin").items()])


REAL = [c for c in W.FEATURES if c not in ("hour", "day_of_week", "month", "value")]


@query(f"""{IND} SELECT {SQL_IDS}, {', '.join(f'round("{c}", 6) + 0.0 AS "{c}"' for c in REAL)}, "hour", day_of_week, "month" FROM ind""")
def q_all_indicators(spark: SparkSession, d: str) -> DataFrame:
    return indicators(spark, d).select(*IDS, *[r(c) for c in REAL], "hour", "day_of_week", "month")


@query(f"WITH {DAYS}, {GOOD}, {indicators_sql()} SELECT {SQL_IDS}, {', '.join(rr(f'ema_{s}', 4) for s in W.SPANS)} FROM ind")
def q_ema_exact(spark: SparkSession, d: str) -> DataFrame:
    """Series of over two thousand bars: the recursion goes over several blocks."""
    return W.with_ema(daily(spark, d)).select(*IDS, *[r(f"ema_{s}", 4) for s in W.SPANS])


# Splits and labels --------------------------------------------------------------------------------------------------


def split_sql(least: int, bars: str = BARS) -> str:
    return f"""{bars}, {GOOD}, n0 AS (SELECT *, count(*) OVER (PARTITION BY ticker, timeframe) AS n, row_number() OVER ({OWN}) - 1 AS i FROM c),
n1 AS (SELECT *, CASE WHEN floor(n * 0.7) < {least} THEN {least} ELSE floor(n * CAST(0.7 AS DOUBLE)) END AS first, CASE WHEN floor(n * 0.7) < {least} THEN {least} + floor((n - {least}) * 0.5) ELSE floor(n * CAST({0.7 + 0.15!r} AS DOUBLE)) END AS second FROM n0),
sp AS (SELECT * EXCLUDE (n, i, first, second), CASE WHEN n >= {least} THEN CASE WHEN i < first THEN 'train' WHEN i < second THEN 'val' ELSE 'test' END END AS split FROM n1)"""


LEAST = 100


@query(f"WITH {split_sql(1000, DAYS)} SELECT {SQL_IDS}, split FROM sp")
def q_time_split(spark: SparkSession, d: str) -> DataFrame:
    return S.time_split(daily(spark, d)).select(*IDS, "split")


@query(f"WITH {split_sql(1000, DAYS)} SELECT {SQL_IDS}, split, CAST(row_number() OVER ({OWN}) - 1 AS INT) AS position, CAST(row_number() OVER (PARTITION BY ticker, timeframe, split ORDER BY \"begin\") - 1 AS INT) AS split_position FROM sp")
def q_split_positions(spark: SparkSession, d: str) -> DataFrame:
    return S.with_positions(S.time_split(daily(spark, d))).select(*IDS, "split", "position", "split_position")


@query(f'WITH {split_sql(1000, DAYS)} SELECT ticker, timeframe, split, min("begin") AS start, max("begin") AS finish, count(*) AS n FROM sp GROUP BY ticker, timeframe, split')
def q_split_periods(spark: SparkSession, d: str) -> DataFrame:
    return S.split_periods(S.time_split(daily(spark, d)))


MIXED_UP = "CASE WHEN split = 'test' AND left(ticker, 1) IN ('1', '4') AND dayofmonth(\"begin\") = 1 THEN 'train' WHEN split = 'val' AND left(ticker, 1) = '2' AND dayofmonth(\"begin\") = 15 THEN 'test' ELSE split END"


@query(f"""WITH {split_sql(1000, DAYS)}, mixed AS (SELECT * REPLACE ({MIXED_UP} AS split) FROM sp), e AS (SELECT ticker, timeframe, {', '.join(f"{f}(\"begin\") FILTER (WHERE split = '{x}') AS {x}_{f}" for x in ('train', 'val', 'test') for f in ('min', 'max'))} FROM mixed GROUP BY ticker, timeframe)
 SELECT ticker, timeframe FROM e WHERE train_max >= val_min OR val_max >= test_min OR train_max >= test_min""")
def q_split_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Splits of some series are mixed up; the others are found clean."""
    split = S.time_split(daily(spark, d))
    return S.leaks(split.withColumn("split", F.expr(MIXED_UP.replace('"begin"', "begin")))).select("ticker", "timeframe")


@query(f"""WITH {BARS}, {GOOD}, n0 AS (SELECT *, count(*) OVER (PARTITION BY ticker, timeframe) AS n, row_number() OVER ({OWN}) - 1 AS i FROM c), f AS (SELECT *, unnest([0, 1, 2]) AS fold FROM n0),
 g AS (SELECT *, CASE WHEN i < 50 + fold * 20 THEN 'train' WHEN i >= 55 + fold * 20 AND i < 75 + fold * 20 THEN 'test' END AS part FROM f WHERE n >= 75 + fold * 20)
 SELECT ticker, CAST(fold AS INT) AS fold, part, count(*) AS n, min("begin") AS start, max("begin") AS finish FROM g WHERE part IS NOT NULL GROUP BY ticker, fold, part""")
def q_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    folds = S.walk_forward(hourly(spark, d), 3, 50, 20, 5)
    return folds.groupBy("ticker", "fold", "part").agg(F.count("*").alias("n"), F.min("begin").alias("start"), F.max("begin").alias("finish"))


K = 3
KEYED = ("ticker", "timeframe")
SPLIT = f"WITH {split_sql(LEAST)}, {indicators_sql('ticker, timeframe, split', 'sp')}"
MOVED = f"""{SPLIT}, mv AS (SELECT *, (lead(close) OVER (PARTITION BY ticker, timeframe, split ORDER BY "begin") - close) / CASE WHEN abs(atr) < 1e-8 THEN 1e-8 ELSE atr END AS move,
 lead(close) OVER (PARTITION BY ticker, timeframe, split ORDER BY "begin") / nullif(close, 0) - 1 AS forward_return FROM ind WHERE split IS NOT NULL)"""
EDGES = f"{MOVED}, ed AS (SELECT ticker, timeframe, quantile_cont(move, [{', '.join(repr(k / K) for k in range(K + 1))}]) AS edges, count(move) AS n_fitted FROM mv WHERE split = 'train' GROUP BY ticker, timeframe)"
TOKENS = f"{EDGES}, tk AS (SELECT mv.*, CASE WHEN move IS NULL OR edges IS NULL THEN -1 ELSE greatest(0, least({K - 1}, len(list_filter(edges, lambda e: e <= move)) - 1)) END AS token FROM mv LEFT JOIN ed USING (ticker, timeframe))"


def moved(spark: SparkSession, d: str) -> DataFrame:
    keys = T.SPLIT_KEYS
    parts = stored(S.time_split(hourly(spark, d), least_train=LEAST).where("split is not null"), "split")
    frame = stored(W.with_indicators(parts, keys), "indicators")
    return L.with_forward(frame, {1: ("move", "forward_return")}, keys)


def tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of each series by edges of its own training split."""
    frame = moved(spark, d)
    return stored(L.with_tokens(frame, L.fit_edges(frame.where("split = 'train'"), K, keys=KEYED), K, keys=KEYED), "tokens")


@query(f"{MOVED} SELECT {SQL_IDS}, split, {rr('move')}, {rr('forward_return')} FROM mv")
def q_forward_move(spark: SparkSession, d: str) -> DataFrame:
    return moved(spark, d).select(*IDS, "split", r("move"), r("forward_return"))


@query(f"{EDGES} SELECT ticker, {', '.join(rr(f'edges[{k + 1}]', 6, f'edge_{k}') for k in range(K + 1))}, n_fitted FROM ed")
def q_token_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = L.fit_edges(moved(spark, d).where("split = 'train'"), K, keys=KEYED)
    return edges.select("ticker", *[r(F.element_at("edges", k + 1), 6, f"edge_{k}") for k in range(K + 1)], "n_fitted")


@query(f"{TOKENS} SELECT {SQL_IDS}, split, CAST(token AS INT) AS token FROM tk")
def q_tokens(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).select(*IDS, "split", "token")


@query(f"{TOKENS} SELECT ticker, CAST(token AS INT) AS token, count(*) AS n, {rr('avg(forward_return)', 6, 'mean_forward_return')} FROM tk GROUP BY ticker, token")
def q_token_distribution(spark: SparkSession, d: str) -> DataFrame:
    return tokens(spark, d).groupBy("ticker", "token").agg(F.count("*").alias("n"), r(F.avg("forward_return"), 6, "mean_forward_return"))


# Windows ------------------------------------------------------------------------------------------------------------

LENGTH, WINDOW_FEATURES = 8, ["close", "body_ratio", "return_1"]
ROWS = f"""{TOKENS}, ti AS (SELECT *, row_number() OVER (PARTITION BY ticker, timeframe, split ORDER BY "begin") AS i FROM tk),
wn AS (SELECT *, count(*) OVER fr AS n, sum(close) OVER fr AS s_close, sum(body_ratio) OVER fr AS s_body, sum(return_1) OVER fr AS s_return, sum(i * close) OVER fr - (i - {LENGTH}) * sum(close) OVER fr AS w_close, sum(i * body_ratio) OVER fr - (i - {LENGTH}) * sum(body_ratio) OVER fr AS w_body
 FROM ti WINDOW fr AS (PARTITION BY ticker, timeframe, split ORDER BY "begin" ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW))"""


def column_of(k: int, flat: bool) -> Column:
    n = len(WINDOW_FEATURES)
    return F.filter("window", lambda x, i: i % n == k) if flat else F.transform("window", lambda row: F.element_at(row, k + 1))


def total(k: int, flat: bool) -> Column:
    return F.aggregate(column_of(k, flat), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


def weighed(k: int, flat: bool) -> Column:
    """Values by their places, from 1 on: tells whether they are in order."""
    return F.aggregate(F.transform(column_of(k, flat), lambda x, i: x * (i + 1)), F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))


@query(f"{ROWS} SELECT {SQL_IDS}, CAST(token AS INT) AS token, {LENGTH * 3} AS width, {rr('s_close', 4, 'sum_close')}, {rr('w_close', 3, 'weighed_close')}, {rr('coalesce(s_return, 0)', 6, 'sum_return')} FROM wn WHERE n = {LENGTH} AND token <> -1")
def q_tabular_window(spark: SparkSession, d: str) -> DataFrame:
    w = V.tabular_windows(tokens(spark, d), LENGTH, WINDOW_FEATURES, T.SPLIT_KEYS)
    return w.select(*IDS, "token", F.size("window").alias("width"), r(total(0, True), 4, "sum_close"), r(weighed(0, True), 3, "weighed_close"), r(total(2, True), 6, "sum_return"))


@query(f"{ROWS} SELECT {SQL_IDS}, CAST(token AS INT) AS token, {LENGTH} AS steps, {rr('s_body', 6, 'sum_body')}, {rr('w_body', 5, 'weighed_body')} FROM wn WHERE n = {LENGTH} AND token <> -1")
def q_sequence_window(spark: SparkSession, d: str) -> DataFrame:
    w = V.sequence_windows(tokens(spark, d), LENGTH, WINDOW_FEATURES, T.SPLIT_KEYS)
    return w.select(*IDS, "token", F.size("window").alias("steps"), r(total(1, False), 6, "sum_body"), r(weighed(1, False), 5, "weighed_body"))


CONTEXTS = f"""{TOKENS}, cx AS (SELECT *, list(token) OVER (PARTITION BY ticker, timeframe, split ORDER BY "begin" ROWS BETWEEN {LENGTH} PRECEDING AND 1 PRECEDING) AS context FROM tk),
tw AS (SELECT * FROM cx WHERE len(context) = {LENGTH} AND NOT list_contains(context, -1) AND token <> -1)"""


def contexts(spark: SparkSession, d: str) -> DataFrame:
    return V.token_windows(tokens(spark, d), LENGTH, 1, T.SPLIT_KEYS)


@query(f"{CONTEXTS} SELECT {SQL_IDS}, CAST(token AS INT) AS token, array_to_string(context, ',') AS context FROM tw")
def q_token_window(spark: SparkSession, d: str) -> DataFrame:
    return contexts(spark, d).select(*IDS, "token", F.array_join(F.col("context").cast("array<string>"), ",").alias("context"))


@query(f"""{IND}, ranked AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY "begin" DESC) AS back FROM ind) SELECT ticker, max("begin") AS last_begin, {LENGTH} AS steps, {rr('sum(close)', 4, 'sum_close')}, {rr(f'sum(({LENGTH + 1} - back) * close)', 3, 'weighed_close')} FROM ranked WHERE back <= {LENGTH} GROUP BY ticker HAVING count(*) = {LENGTH}""")
def q_inference_window(spark: SparkSession, d: str) -> DataFrame:
    w = V.last_windows(indicators(spark, d), LENGTH, WINDOW_FEATURES)
    return w.select("ticker", "last_begin", F.size("window").alias("steps"), r(total(0, False), 4, "sum_close"), r(weighed(0, False), 3, "weighed_close"))


# Frequency models and metrics ---------------------------------------------------------------------------------------

MARKOV = f"""{CONTEXTS}, tr AS (SELECT * FROM tw WHERE split = 'train'), mc AS (SELECT context[{LENGTH - 1}] AS s1, context[{LENGTH}] AS s2, token AS nxt, count(*) AS n FROM tr GROUP BY 1, 2, 3),
mp AS (SELECT *, n / sum(n) OVER (PARTITION BY s1, s2) AS p FROM mc), st AS (SELECT s1, s2, {', '.join(f'coalesce(max(p) FILTER (WHERE nxt = {k}), 0) AS p{k}' for k in range(K))} FROM mp GROUP BY s1, s2),
df0 AS (SELECT {', '.join(f'avg(CASE WHEN token = {k} THEN 1.0 ELSE 0.0 END) AS d{k}' for k in range(K))} FROM tr),
pd0 AS (SELECT tw.*, {', '.join(f'coalesce(p{k}, d{k}) AS q{k}' for k in range(K))} FROM tw CROSS JOIN df0 LEFT JOIN st ON st.s1 = tw.context[{LENGTH - 1}] AND st.s2 = tw.context[{LENGTH}]),
pd AS (SELECT *, CASE WHEN q0 >= q1 AND q0 >= q2 THEN 0 WHEN q1 >= q2 THEN 1 ELSE 2 END AS prediction FROM pd0)"""
ORDER = 2


def predictions(spark: SparkSession, d: str) -> DataFrame:
    found = contexts(spark, d)
    table, default = M.markov_table(found.where("split = 'train'"), K, ORDER)
    return M.markov_predict(found, table, default, ORDER)


@query(f"""{TOKENS}, t AS (SELECT ticker, token, count(*) AS n FROM tk WHERE split = 'train' AND token <> -1 GROUP BY ticker, token), s AS (SELECT ticker, sum(n) AS total, {', '.join(f'coalesce(max(n) FILTER (WHERE token = {k}), 0) AS n{k}' for k in range(K))} FROM t GROUP BY ticker)
 SELECT ticker, CAST(CASE WHEN n0 >= n1 AND n0 >= n2 THEN 0 WHEN n1 >= n2 THEN 1 ELSE 2 END AS INT) AS prediction, {', '.join(rr(f'n{k} / total', 6, f'p{k}') for k in range(K))} FROM s""")
def q_majority_fit(spark: SparkSession, d: str) -> DataFrame:
    fitted = M.majority(tokens(spark, d).where("split = 'train'"), K, ("ticker",))
    return fitted.select("ticker", "prediction", *[r(F.element_at("probabilities", k + 1), 6, f"p{k}") for k in range(K)])


@query(f"{MARKOV} SELECT concat(s1, ',', s2) AS state, CAST(nxt AS INT) AS next, n, {rr('p')} FROM mp")
def q_markov_transitions(spark: SparkSession, d: str) -> DataFrame:
    moves = M.transitions(contexts(spark, d).where("split = 'train'"), ORDER)
    return moves.select(F.array_join(F.col("state").cast("array<string>"), ",").alias("state"), "next", "n", r("p"))


@query(f"{MARKOV} SELECT {SQL_IDS}, CAST(prediction AS INT) AS prediction, {', '.join(rr(f'q{k}', 6, f'p{k}') for k in range(K))} FROM pd")
def q_markov_predict(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).select(*IDS, "prediction", *[r(F.element_at("probabilities", k + 1), 6, f"p{k}") for k in range(K)])


@query(f"{MARKOV} SELECT split, CAST(token AS INT) AS actual, CAST(prediction AS INT) AS predicted, count(*) AS n FROM pd GROUP BY split, token, prediction")
def q_confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return E.confusion(predictions(spark, d), ("split",))


@query(f"""{MARKOV}, lab AS (SELECT split, token AS c FROM pd UNION SELECT split, prediction FROM pd), m AS (SELECT lab.split, lab.c, count(*) FILTER (WHERE token = c) AS support, count(*) FILTER (WHERE prediction = c) AS said, count(*) FILTER (WHERE token = c AND prediction = c) AS hit FROM lab JOIN pd ON pd.split = lab.split GROUP BY 1, 2),
 m1 AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS "precision", coalesce(hit / nullif(support, 0), 0) AS recall FROM m), m2 AS (SELECT *, coalesce(2 * "precision" * recall / nullif("precision" + recall, 0), 0) AS f1 FROM m1)
 SELECT split, CAST(sum(support) AS BIGINT) AS n, {rr('sum(hit) / sum(support)', 6, 'accuracy')}, {rr('avg(f1)', 6, 'macro_f1')}, {rr('sum(f1 * support) / sum(support)', 6, 'weighted_f1')}, {rr('avg("precision")', 6, 'macro_precision')}, {rr('sum("precision" * support) / sum(support)', 6, 'weighted_precision')}, {rr('avg(recall)', 6, 'macro_recall')}, {rr('sum(recall * support) / sum(support)', 6, 'weighted_recall')} FROM m2 GROUP BY split""")
def q_classification_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = E.class_metrics(E.confusion(predictions(spark, d), ("split",)), ("split",))
    return m.select("split", "n", *[r(c) for c in m.columns if c not in ("split", "n")])


@query(f"{MARKOV} SELECT split, {rr('avg(-ln(greatest(CASE token WHEN 0 THEN q0 WHEN 1 THEN q1 ELSE q2 END, 2.220446049250313e-16)))', 6, 'log_loss')} FROM pd GROUP BY split")
def q_log_loss(spark: SparkSession, d: str) -> DataFrame:
    return E.log_loss(predictions(spark, d), ("split",)).select("split", r("log_loss"))


@query(f"{TOKENS}, t AS (SELECT token, count(*) AS n FROM tk WHERE token <> -1 GROUP BY token) SELECT CAST(token AS INT) AS token, n, {rr(f'sum(n) OVER () / ({K} * n)', 6, 'weight')} FROM t")
def q_class_weights(spark: SparkSession, d: str) -> DataFrame:
    return M.class_weights(tokens(spark, d).where("token <> -1"), K).groupBy("token").agg(F.count("*").alias("n"), r(F.first("weight"), 6, "weight"))


# Signals, equity, outcomes ------------------------------------------------------------------------------------------

SIGNED = f"{TOKENS}, sg AS (SELECT *, CASE WHEN token < 0 THEN 1 ELSE token END AS prediction FROM tk), sn AS (SELECT *, CAST(sign(prediction - {K // 2}) AS INT) AS signal FROM sg)"
EQUITY = f"""{SIGNED}, e0 AS (SELECT *, coalesce(close / nullif(lag(close) OVER ({OWN}), 0) - 1, 0) AS bar_return, abs(signal - lag(signal, 1, 0) OVER ({OWN})) AS traded FROM sn), e1 AS (SELECT *, signal * bar_return - traded * 0.0005 AS strategy_return FROM e0),
e2 AS (SELECT *, 100000.0 * product(1 + strategy_return) OVER {SO_FAR} AS equity FROM e1), eq AS (SELECT *, (max(equity) OVER {SO_FAR} - equity) / nullif(max(equity) OVER {SO_FAR}, 0) AS drawdown FROM e2)"""


def signed(spark: SparkSession, d: str) -> DataFrame:
    """Tokens as predictions, unknown ones as the middle class, with their signals."""
    return E.with_signals(tokens(spark, d).withColumn("prediction", F.when(F.col("token") < 0, 1).otherwise(F.col("token"))), K)


@query(f"{SIGNED} SELECT {SQL_IDS}, CAST(prediction AS INT) AS prediction, signal, CASE WHEN signal > 0 THEN 'buy' WHEN signal < 0 THEN 'sell' ELSE 'hold' END AS action FROM sn")
def q_signals(spark: SparkSession, d: str) -> DataFrame:
    return signed(spark, d).select(*IDS, "prediction", "signal", X.class_action("prediction", K).alias("action"))


@query(f"{EQUITY} SELECT {SQL_IDS}, {rr('strategy_return')}, {rr('log10(1 + abs(equity / 100000.0))', 5, 'growth')}, {rr('drawdown', 5)}, CAST(traded AS INT) AS traded FROM eq")
def q_backtest_curve(spark: SparkSession, d: str) -> DataFrame:
    return E.backtest_curve(signed(spark, d)).select(*IDS, r("strategy_return"), r(F.log10(1 + F.abs(F.col("equity") / 100000.0)), 5, "growth"), r("drawdown", 5), F.col("traded").cast("int").alias("traded"))


@query(f"""{EQUITY} SELECT ticker, {rr('log10(1 + abs(arg_max(equity, "begin") / 100000.0 - 1))', 4, 'log_return')}, {rr('coalesce(avg(strategy_return) / nullif(stddev_pop(strategy_return), 0), 0)', 5, 'sharpe_ratio')}, {rr('log10(1 + max(drawdown))', 4, 'log_drawdown')}, count(*) FILTER (WHERE traded > 0) AS n_trades,
 {rr('count(*) FILTER (WHERE strategy_return > 0) / count(*)', 6, 'win_rate')}, {rr('coalesce(count(*) FILTER (WHERE strategy_return > 0) / nullif(count(*) FILTER (WHERE strategy_return <> 0), 0), 0)', 6, 'hit_rate')} FROM eq GROUP BY ticker, timeframe""")
def q_backtest_summary(spark: SparkSession, d: str) -> DataFrame:
    s = E.backtest_summary(E.backtest_curve(signed(spark, d)))
    return s.select("ticker", r(F.log10(1 + F.abs("total_return")), 4, "log_return"), r("sharpe_ratio", 5), r(F.log10(1 + F.col("max_drawdown")), 4, "log_drawdown"), "n_trades", r("win_rate"), r("hit_rate"))


TRADES = f"""{MARKOV}, s0 AS (SELECT *, CAST(sign(prediction - 1) AS INT) AS ps, CAST(sign(token - 1) AS INT) AS ts0 FROM pd WHERE forward_return IS NOT NULL), s1 AS (SELECT *, abs(ps - lag(ps, 1, 0) OVER ({OWN})) AS dp FROM s0), s2 AS (SELECT *, ps * forward_return - dp * 0.0005 AS sr FROM s1),
s3 AS (SELECT *, product(1 + sr) OVER {SO_FAR} AS eq FROM s2), s4 AS (SELECT *, (max(eq) OVER {SO_FAR} - eq) / nullif(max(eq) OVER {SO_FAR}, 0) AS dd FROM s3)"""


@query(f"""{TRADES} SELECT ticker, {rr('avg(CASE WHEN ps = ts0 THEN 1.0 ELSE 0.0 END)', 6, 'action_accuracy')}, {rr('coalesce(count(*) FILTER (WHERE ps <> 0 AND sign(forward_return) = ps) / nullif(count(*) FILTER (WHERE ps <> 0), 0), 0)', 6, 'active_direction_hit_rate')}, {rr('avg(CASE WHEN ps <> 0 THEN 1.0 ELSE 0.0 END)', 6, 'active_share')},
 {rr('log10(1 + abs(arg_max(eq, "begin") - 1))', 4, 'log_return')}, {rr('coalesce(avg(sr) / nullif(stddev_pop(sr), 0), 0)', 5, 'sharpe_per_trade')}, {rr('log10(1 + max(dd))', 4, 'log_drawdown')}, count(*) FILTER (WHERE dp > 0) AS n_trades FROM s4 GROUP BY ticker, timeframe""")
def q_trading_summary(spark: SparkSession, d: str) -> DataFrame:
    s = E.trading_summary(predictions(spark, d), K)
    return s.select("ticker", r("action_accuracy"), r("active_direction_hit_rate"), r("active_share"), r(F.log10(1 + F.abs("total_return")), 4, "log_return"), r("sharpe_per_trade", 5), r(F.log10(1 + F.col("max_drawdown")), 4, "log_drawdown"), "n_trades")


@query(f"""{MARKOV}, k AS (SELECT ticker, count(DISTINCT prediction) AS kinds FROM pd GROUP BY ticker), u AS (SELECT pd.*, CASE WHEN prediction > floor(kinds / 2) THEN forward_return ELSE 0 END AS x FROM pd JOIN k USING (ticker)), v AS (SELECT *, sum(x) OVER {SO_FAR} AS cum FROM u), w0 AS (SELECT *, max(cum) OVER {SO_FAR} - cum AS dd FROM v)
 SELECT ticker, {rr('sum(x)', 5, 'total_pnl')}, {rr('count(*) FILTER (WHERE x > 0) / count(*)', 6, 'win_rate')}, {rr('coalesce(avg(x) / nullif(stddev_pop(x), 0), 0)', 5, 'sharpe_ratio')}, {rr('max(dd)', 5, 'max_drawdown')} FROM w0 GROUP BY ticker, timeframe""")
def q_simple_trading_metrics(spark: SparkSession, d: str) -> DataFrame:
    return E.simple_trading_metrics(predictions(spark, d)).select("ticker", r("total_pnl", 5), r("win_rate"), r("sharpe_ratio", 5), r("max_drawdown", 5))


@query(f"""WITH {BARS}, {GOOD}, p AS (SELECT ticker, "begin" AS ts0, close AS c0, CAST((hour("begin") % 7) AS INT) AS prediction FROM c), o AS (SELECT p.*, (c.close - c0) / nullif(c0, 0) AS ret FROM p JOIN c ON c.ticker = p.ticker AND c."begin" = p.ts0 + INTERVAL 3 HOUR), g AS (SELECT *, CASE WHEN prediction > 3 THEN ret ELSE 0 END AS gain FROM o)
 SELECT ticker, count(*) AS n_predictions, {rr('avg(CASE WHEN prediction = CASE WHEN ret > 0 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END)', 6, 'accuracy')}, {rr('sum(gain)', 5, 'total_pnl')}, {rr('avg(CASE WHEN gain > 0 THEN 1.0 ELSE 0.0 END)', 6, 'hit_rate')}, count(*) FILTER (WHERE gain > 0) AS n_profitable_trades FROM g GROUP BY ticker""")
def q_online_eval(spark: SparkSession, d: str) -> DataFrame:
    c = hourly(spark, d)
    said = c.select(*SERIES, F.col("begin").alias("timestamp"), (F.hour("begin") % 7).alias("prediction"))
    rep = E.online_report(E.outcomes(said, c, 3))
    return rep.select("ticker", "n_predictions", r("accuracy"), r("total_pnl", 5), r("hit_rate"), "n_profitable_trades")


# Decisions ----------------------------------------------------------------------------------------------------------


def requests(spark: SparkSession, d: str) -> DataFrame:
    """A request of each bar: what a caller would send, made of its indicators by fixed rules."""
    f, h = indicators(spark, d), F.hour("begin")
    p = F.array(*[((h + k * k) % 5 + 1) / F.lit(1.0) for k in range(K)])
    whole = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    title = F.when(h % 6 == 0, "Profit BEAT").when(h % 6 == 1, "trading halt").otherwise("nothing new")
    return f.select(
        *IDS, F.transform(p, lambda x: x / whole).alias("probabilities"), F.when(h % 3 == 0, "buy").when(h % 3 == 1, " Sell").otherwise("wait").alias("action"), F.when(h % 11 != 10, (h % 10) / F.lit(9.0)).alias("confidence"),
        F.col("close").alias("last_close"), (F.lit(10.0) + h * 3.5).alias("rsi"), F.coalesce("return_1", F.lit(0.0)).alias("macd_line"), F.coalesce("return_3", F.lit(0.0)).alias("macd_signal"), (-F.col("ema_20_distance")).alias("ema_20"), (-F.col("ema_50_distance")).alias("ema_50"),
        F.coalesce("volume_ratio", F.lit(1.0)).alias("volume_ratio"), F.array(F.col("low"), F.col("low") * 0.9, F.col("high") * 1.1).alias("support_levels"), F.array(F.col("high"), F.col("high") * 1.2).alias("resistance_levels"),
        F.array(F.struct(title.alias("title"), F.lit("").alias("summary"))).cast(Q.NEWS).alias("news"), (h % 5 * 20.0 - 20.0).alias("position"), (h % 4 * 0.31).alias("exposure"), (h % 8 * -200.0).alias("day_pnl"), F.lit(0.0).alias("max_position"), F.lit(0.0).alias("max_exposure"), F.lit(0.0).alias("max_daily_loss"),
    )


ASK = f"""{IND}, rq AS (SELECT {SQL_IDS}, hour("begin") AS h, close, low, high, 10.0 + hour("begin") * 3.5 AS rsi, coalesce(return_1, 0) AS ml, coalesce(return_3, 0) AS ms, -ema_20_distance AS e20, -ema_50_distance AS e50, coalesce(volume_ratio, 1) AS vr,
 CASE WHEN hour("begin") % 11 <> 10 THEN (hour("begin") % 10) / 9.0 END AS confidence, {', '.join(f'((hour("begin") + {k * k}) % 5 + 1)::DOUBLE AS w{k}' for k in range(K))}, (hour("begin") % 5) * 20.0 - 20.0 AS position, (hour("begin") % 4) * 0.31::DOUBLE AS exposure, (hour("begin") % 8) * -200.0 AS day_pnl FROM ind),
d0 AS (SELECT *, w2 / (w0 + w1 + w2) - w0 / (w0 + w1 + w2) AS direction, CASE WHEN close <> 0 THEN list_max(list_filter([low, low * 0.9, high * 1.1], lambda x: x <= close)) END AS support, CASE WHEN close <> 0 THEN list_min(list_filter([high, high * 1.2], lambda x: x >= close)) END AS resistance FROM rq),
d1 AS (SELECT *, CASE WHEN rsi < 35 THEN 0.35::DOUBLE ELSE 0::DOUBLE END + CASE WHEN ml > ms THEN 0.25::DOUBLE ELSE 0::DOUBLE END + CASE WHEN e20 > e50 THEN 0.25::DOUBLE ELSE 0::DOUBLE END + CASE WHEN close <= support * 1.01::DOUBLE THEN 0.15::DOUBLE ELSE 0::DOUBLE END + CASE WHEN h % 6 = 0 THEN 0.2::DOUBLE ELSE 0::DOUBLE END AS bull,
 CASE WHEN rsi > 65 THEN 0.35::DOUBLE ELSE 0::DOUBLE END + CASE WHEN ml < ms THEN 0.25::DOUBLE ELSE 0::DOUBLE END + CASE WHEN e20 < e50 THEN 0.25::DOUBLE ELSE 0::DOUBLE END + CASE WHEN close >= resistance * 0.99::DOUBLE THEN 0.15::DOUBLE ELSE 0::DOUBLE END + CASE WHEN h % 6 = 1 THEN 0.25::DOUBLE ELSE 0::DOUBLE END AS bear,
 concat_ws(',', CASE WHEN rsi < 20 OR rsi > 80 THEN 'extreme_rsi' END, CASE WHEN vr >= 2.5 THEN 'volume_spike' END, CASE WHEN h % 6 = 1 THEN 'negative_news' END, CASE WHEN exposure >= 0.9 THEN 'high_portfolio_exposure' END) AS flags FROM d0),
d2 AS (SELECT *, bull - bear AS diff, CASE WHEN bull - bear > 0.15::DOUBLE THEN 'bullish' WHEN bull - bear < -0.15::DOUBLE THEN 'bearish' ELSE 'neutral' END AS side, least(1.0::DOUBLE, abs(bull - bear)) AS strength FROM d1)"""


@query(f"{ASK} SELECT {SQL_IDS}, {rr('direction', 6, 'algo_direction')} FROM d0")
def q_algo_direction(spark: SparkSession, d: str) -> DataFrame:
    return requests(spark, d).select(*IDS, r(X.expected_position("probabilities"), 6, "algo_direction"))


@query(f"{ASK} SELECT {SQL_IDS}, {rr('support')}, {rr('resistance')} FROM d0")
def q_nearest_levels(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("last_close")
    return requests(spark, d).select(*IDS, r(X.nearest("support_levels", c, True), 6, "support"), r(X.nearest("resistance_levels", c, False), 6, "resistance"))


@query(f"{ASK} SELECT {SQL_IDS}, side AS llm_direction, {rr('strength', 6, 'llm_strength')}, {rr('''CASE WHEN side = 'neutral' THEN least(0.3::DOUBLE, 0.2::DOUBLE + 0.3::DOUBLE * greatest(bull, bear) + 0.3::DOUBLE * strength) ELSE least(1.0::DOUBLE, 0.2::DOUBLE + 0.3::DOUBLE * greatest(bull, bear) + 0.3::DOUBLE * strength) END''', 6, 'llm_confidence')}, flags AS risk_flags FROM d2")
def q_heuristic_score(spark: SparkSession, d: str) -> DataFrame:
    s = Q.heuristic_signal(requests(spark, d))
    return s.select(*IDS, "llm_direction", r("llm_strength"), r("llm_confidence"), F.array_join("risk_flags", ",").alias("risk_flags"))


SCORED = f"""{ASK}, d3 AS (SELECT *, CASE WHEN confidence IS NULL THEN 0.0 ELSE confidence END AS ac, CASE WHEN confidence IS NULL THEN 0.0 ELSE direction END AS ad, CASE WHEN side = 'neutral' THEN least(0.3::DOUBLE, 0.2::DOUBLE + 0.3::DOUBLE * greatest(bull, bear) + 0.3::DOUBLE * strength) ELSE least(1.0::DOUBLE, 0.2::DOUBLE + 0.3::DOUBLE * greatest(bull, bear) + 0.3::DOUBLE * strength) END AS lc FROM d2),
d4 AS (SELECT *, 0.6::DOUBLE * ad * ac + 0.4::DOUBLE * CASE side WHEN 'bullish' THEN 1 WHEN 'bearish' THEN -1 ELSE 0 END * strength * lc AS score, least(ac, greatest(lc, 0.2)) AS dc FROM d3),
d5 AS (SELECT *, CASE WHEN flags <> '' THEN 'HOLD' WHEN score >= 0.25::DOUBLE THEN 'BUY' WHEN score <= -0.25::DOUBLE THEN 'SELL' ELSE 'HOLD' END AS act FROM d4),
d6 AS (SELECT *, CASE WHEN act = 'HOLD' THEN 0 WHEN act = 'BUY' THEN least(100.0 * dc, greatest(100.0 - abs(position), 0)) WHEN position <= 0 THEN 0 ELSE least(100.0 * dc, position) END AS size FROM d5),
d7 AS (SELECT *, CASE WHEN act = 'HOLD' THEN '' ELSE concat_ws('; ', CASE WHEN day_pnl <= -1000 THEN 'daily loss limit exceeded' END, CASE WHEN abs(exposure) >= 0.8 THEN 'portfolio exposure limit exceeded' END, CASE WHEN act = 'SELL' AND position <= 0 THEN 'short selling is disabled' END, CASE WHEN size = 0 THEN 'no available position size after limits' END) END AS reasons FROM d6)"""


def steps(spark: SparkSession, d: str) -> DataFrame:
    """Scores of all requests. On a threshold the order of additions in doubles decides, which is the same in the SQL."""
    df = requests(spark, d)
    failed = F.col("confidence").isNull()
    df = df.withColumns(Q.model_signal()).withColumns({"algo_direction": F.when(failed, 0.0).otherwise(F.col("algo_direction")), "algo_confidence": F.when(failed, 0.0).otherwise(F.col("algo_confidence"))})
    return Q.weighted_score(Q.heuristic_signal(df))


@query(f"{SCORED} SELECT {SQL_IDS}, {rr('score')}, act AS action, {rr('dc', 6, 'decision_confidence')} FROM d5")
def q_aggregate_score(spark: SparkSession, d: str) -> DataFrame:
    return steps(spark, d).select(*IDS, r("score"), "action", r("decision_confidence"))


@query(f"{SCORED} SELECT {SQL_IDS}, act AS action, {rr('size', 6, 'recommended_size')}, {rr('''CASE act WHEN 'BUY' THEN position + size WHEN 'SELL' THEN position - size ELSE position END''', 6, 'resulting_position')}, reasons AS blocking_reasons, reasons = '' AS approved FROM d7")
def q_risk_assess(spark: SparkSession, d: str) -> DataFrame:
    a = Q.risk(steps(spark, d))
    return a.select(*IDS, "action", r("recommended_size"), r("resulting_position"), F.array_join("blocking_reasons", "; ").alias("blocking_reasons"), "approved")


@query(f"""{SCORED} SELECT {SQL_IDS}, CASE WHEN confidence IS NULL OR (act <> 'HOLD' AND reasons <> '') THEN 'HOLD' ELSE act END AS action, round(CASE WHEN confidence IS NULL THEN 0 ELSE score END, 6) + 0.0 AS score,
 CASE WHEN confidence IS NULL THEN 'ml_unavailable_fallback' WHEN act <> 'HOLD' AND reasons <> '' THEN 'risk_manager_block' WHEN flags <> '' THEN 'llm_risk_flag_override' WHEN act = 'BUY' THEN 'score above buy threshold' WHEN act = 'SELL' THEN 'score below sell threshold' ELSE 'score inside hold band' END AS reason FROM d7""")
def q_decision_eval(spark: SparkSession, d: str) -> DataFrame:
    return Q.evaluate_decisions(requests(spark, d)).select(*IDS, "action", r("score"), "reason")


# Blocks, texts, numbers ---------------------------------------------------------------------------------------------


@query(f'WITH {BARS} SELECT ticker, "begin", "end", {rr("open", 4)}, {rr("high", 4)}, {rr("low", 4)}, {rr("close", 4)}, volume FROM bars')
def q_block_decode(spark: SparkSession, d: str) -> DataFrame:
    cols = ["open", "close", "high", "low", "value", "volume", "begin", "end"]
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c in ("begin", "end") else F.col(c).cast("string")
    block = F.to_json(F.struct(F.struct(F.array(*map(F.lit, cols)).alias("columns"), F.collect_list(F.array(*map(text, cols))).alias("data")).alias("candles")))
    blocks = bars_hourly(spark, d).groupBy("ticker", F.to_date("begin").alias("day")).agg(block.alias("json")).drop("day")
    out = B.decode_blocks(blocks)
    return out.select("ticker", "begin", "end", *[r(c, 4) for c in PRICES], "volume")


@query(f"""WITH {BARS} SELECT {SQL_IDS}, {hour_sql('"begin"', '"begin"', '"begin"', 'CAST("begin" AS DATE)::TIMESTAMP', '"begin"', 'NULL', 'NULL', '"begin" + INTERVAL 125 MILLISECOND')} AS time FROM bars""")
def q_flexible_time(spark: SparkSession, d: str) -> DataFrame:
    """Begins as texts in several layouts, with and without a zone, and in two that are none."""
    text = lambda layout, t="begin": F.date_format(t, layout)
    later = F.col("begin") + F.expr("interval 3 hours")
    texts = (text("yyyy-MM-dd'T'HH:mm:ss'Z'"), text("yyyy-MM-dd'T'HH:mm:ss'+03:00'", later), text("' 'yyyy-MM-dd HH:mm:ss' '"), text("yyyy-MM-dd"), text("yyyy-MM-dd'T'HH:mm"), text("dd.MM.yyyy"), "", text("yyyy-MM-dd'T'HH:mm:ss'.125'"))
    return bars_hourly(spark, d).select(*IDS, X.flexible_time(by_hour(texts)).alias("time"))


@query(f"WITH {BARS} SELECT {SQL_IDS}, {rr(hour_sql('close', '-close * 100', 'close', '0', '0', '0'), 4, 'number')} FROM bars")
def q_lenient_float(spark: SparkSession, d: str) -> DataFrame:
    """Closes as texts: plain, with an exponent and spaces, with letters behind, with letters before, and none."""
    close = F.col("close").cast("string")
    texts = (close, F.concat(F.lit(" -"), close, F.lit("e2 ")), F.concat(close, F.lit("abc")), F.concat(F.lit("abc"), close), "", F.lit(None).cast("string"))
    return bars_hourly(spark, d).select(*IDS, r(X.lenient_double(by_hour(texts)), 4, "number"))


@query(f"""WITH {BARS} SELECT {SQL_IDS}, {rr('least(1.0, greatest(-1.0, (close - open) / 10))', 6, 'clamped')}, {rr('CASE WHEN high - low > 0 THEN (close - open) / (high - low) ELSE 0 END', 6, 'guarded')},
 {rr('CASE WHEN abs(high - low) < 1e-8 THEN 1e-8 ELSE high - low END', 8, 'nonzero')}, CAST(sign(hour("begin") % 4 - 2) AS INT) AS sign4, CASE WHEN hour("begin") % 5 > 2 THEN 'buy' WHEN hour("begin") % 5 < 2 THEN 'sell' ELSE 'hold' END AS action5, CAST(greatest(0, least(2, hour("begin") % 7 - 2)) AS INT) AS clipped FROM bars""")
def q_number_functions(spark: SparkSession, d: str) -> DataFrame:
    h, move, span = F.hour("begin"), F.col("close") - F.col("open"), F.col("high") - F.col("low")
    return bars_hourly(spark, d).select(*IDS, r(X.clamp(move / 10, -1.0, 1.0), 6, "clamped"), r(X.guarded_ratio(move, span), 6, "guarded"), r(X.nonzero(span), 8, "nonzero"), X.class_sign(h % 4, 4).alias("sign4"), X.class_action(h % 5, 5).alias("action5"), X.clipped_token(h % 7 - 2, 3).cast("int").alias("clipped"))


OBJECT_SQL = """concat('{"a": "', ticker, '"}')"""


@query(f"""WITH {BARS} SELECT {SQL_IDS}, {hour_sql("'BUY'", "'SELL'", "'HOLD'", "'HOLD'", "'HOLD'")} AS action, {hour_sql('0.0', '0.0', '1.0', '-1.0', '0.0')}::DOUBLE AS direction, CAST({hour_sql('1', '0', '-1', '1', '0')} AS INT) AS news,
 {hour_sql("concat('no ', ticker)", "concat('oops ', ticker)", OBJECT_SQL, "concat('late ', ticker)", 'NULL')} AS message FROM bars""")
def q_text_functions(spark: SparkSession, d: str) -> DataFrame:
    """Actions, directions, news and answers of a service, as texts about each bar."""
    of = lambda *parts: F.concat(*[F.col("ticker") if p == "t" else F.lit(p) for p in parts])
    text = by_hour((" buy ", "Sell", "bullish", "BEARISH ", ""))
    title, summary = by_hour((of("t", " profits BEAT"), of("nothing on ", "t"), of("trading halt of ", "t"), F.lit(None).cast("string"), "")), by_hour(("", F.lit(None).cast("string"), "", "рост и суд", ""))
    body = by_hour((of('{"detail": "no ', "t", '", "error": "z"}'), of(" oops ", "t", " "), of('{"a": "', "t", '"}'), of('{"detail": "", "error": "late ', "t", '"}'), F.lit(None).cast("string")))
    return bars_hourly(spark, d).select(*IDS, X.known_action(text).alias("action"), X.direction_of(text).alias("direction"), X.keyword_class(title, summary).cast("int").alias("news"), X.error_message(body).alias("message"))


@query(f"""WITH {BARS}, a AS (SELECT {SQL_IDS}, [(hour("begin") % 3)::DOUBLE, 1.0, (hour("begin") % 4)::DOUBLE] AS p, list_transform(range(0, 8), lambda i: (i * hour("begin")) % 5) AS t FROM bars)
 SELECT {SQL_IDS}, CAST(list_position(p, list_max(p)) - 1 AS INT) AS argmax, list_max(p) AS top, array_to_string(list_transform(list_filter(range(1, 9), lambda i: list_position(t, t[CAST(i AS INT)]) = i), lambda i: t[CAST(i AS INT)])[1:5], ',') AS five FROM a""")
def q_array_functions(spark: SparkSession, d: str) -> DataFrame:
    h = F.hour("begin")
    p = F.array((h % 3).cast("double"), F.lit(1.0), (h % 4).cast("double"))
    t = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: (i * h) % 5)
    df = bars_hourly(spark, d).select(*IDS, p.alias("p"), t.alias("t"))
    return df.select(*IDS, X.argmax("p").alias("argmax"), X.top_probability("p").alias("top"), F.array_join(X.first_five(X.unique("t")).cast("array<string>"), ",").alias("five"))


@query(f"""WITH {BARS} SELECT ticker, timeframe, concat(ticker, '_', timeframe, '_', strftime(min("begin"), '%Y%m%dT%H%M'), '_', strftime(max("begin"), '%Y%m%dT%H%M')) AS name FROM bars GROUP BY ticker, timeframe""")
def q_batch_names(spark: SparkSession, d: str) -> DataFrame:
    ends = bars_hourly(spark, d).groupBy(*SERIES).agg(F.min("begin").alias("a"), F.max("begin").alias("z"))
    return ends.select(*SERIES, F.concat_ws("_", *SERIES, X.batch_stamp("a"), X.batch_stamp("z")).alias("name"))


@query(f"""WITH {BARS} SELECT strftime("begin", '%Y-%m-%d') AS day, count(DISTINCT ticker) AS tickers, count(DISTINCT timeframe) AS timeframes FROM bars GROUP BY 1 HAVING count(DISTINCT ticker) > 1""")
def q_mixed_batches(spark: SparkSession, d: str) -> DataFrame:
    return C.mixed_batches(bars_hourly(spark, d).withColumn("day", F.date_format("begin", "yyyy-MM-dd")), ("day",))


@query(f"""{ROWS}, w0 AS (SELECT list(return_1) OVER fr AS xs, token, n FROM wn WINDOW fr AS (PARTITION BY ticker, timeframe, split ORDER BY "begin" ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW)), p AS (SELECT unnest(range(0, {LENGTH})) AS place, unnest(xs) AS x FROM w0 WHERE n = {LENGTH} AND token <> -1),
 m AS (SELECT place, coalesce(median(x), 0) AS med FROM p GROUP BY place) SELECT CAST(place AS INT) AS place, {rr('any_value(med)', 6, 'median')}, {rr('avg(coalesce(x, med))', 6, 'mean')}, {rr('stddev_pop(coalesce(x, med))', 6, 'deviation')} FROM p JOIN m USING (place) GROUP BY place""")
def q_scaler_fit(spark: SparkSession, d: str) -> DataFrame:
    """Medians, means and deviations by place, as models scale their windows."""
    s = M.Scaler.fit(V.tabular_windows(tokens(spark, d), LENGTH, ["return_1"], T.SPLIT_KEYS), LENGTH)
    rows = [(i, *x) for i, x in enumerate(zip(s.median, s.mean, s.deviation, strict=True))]
    return spark.createDataFrame(rows, "place int, median double, mean double, deviation double").select("place", r("median"), r("mean"), r("deviation"))


@query(f"""WITH {BARS} SELECT ticker, "begin", "end", open, high, low, close, volume FROM bars WHERE "end" <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def q_stream_bars(spark: SparkSession, d: str) -> DataFrame:
    """Bars of the events as a stream: those that the watermark has closed by the end of the input."""
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    ticks = spark.readStream.schema(schema).parquet(f"{d}/events*.parquet").select(F.col("event_type").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"))
    out = scratch(spark, "bars")
    bars = ST.bar_stream(ticks)
    bars.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    found = spark.read.schema(bars.schema).parquet(f"{out}/data")
    return found.select("ticker", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("begin", "end")], *PRICES, "volume")


# Results of models --------------------------------------------------------------------------------------------------


BY_TICKER = f"""{MARKOV}, lab AS (SELECT ticker, split, token AS c FROM pd UNION SELECT ticker, split, prediction FROM pd), m AS (SELECT lab.ticker, lab.split, lab.c, count(*) FILTER (WHERE token = c) AS support, count(*) FILTER (WHERE prediction = c) AS said, count(*) FILTER (WHERE token = c AND prediction = c) AS hit
 FROM lab JOIN pd ON pd.ticker = lab.ticker AND pd.split = lab.split GROUP BY 1, 2, 3), m1 AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS rc FROM m), m2 AS (SELECT ticker, split, avg(coalesce(2 * p * rc / nullif(p + rc, 0), 0)) AS f1, sum(hit) / sum(support) AS acc FROM m1 GROUP BY 1, 2),
 res AS (SELECT ticker, round(max(f1) FILTER (WHERE split = 'val'), 6) + 0.0 AS val_macro_f1, round(max(acc) FILTER (WHERE split = 'val'), 6) + 0.0 AS val_action_accuracy, round(max(f1) FILTER (WHERE split = 'test'), 6) + 0.0 AS test_macro_f1 FROM m2 GROUP BY ticker)"""


@query(f"{BY_TICKER} SELECT * FROM res ORDER BY val_macro_f1 DESC, val_action_accuracy DESC, test_macro_f1 DESC LIMIT 3")
def q_leaderboard_topk(spark: SparkSession, d: str) -> DataFrame:
    """Cells are tickers: the scores of a Markov model on each one's splits."""
    said = E.class_metrics(E.confusion(predictions(spark, d), ("ticker", "split")), ("ticker", "split"))
    at = lambda c, part, name: r(F.max(F.when(F.col("split") == part, F.col(c))), 6, name)
    cells = said.groupBy("ticker").agg(at("macro_f1", "val", "val_macro_f1"), at("accuracy", "val", "val_action_accuracy"), at("macro_f1", "test", "test_macro_f1"), F.lit(None).cast("string").alias("error"))
    return E.leaderboard(cells, 3).drop("error")


def model_query(name: str):
    """A model of all features over windows of the default length, trained, stored, loaded and asked about all rows."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        spec = T.Spec(name, K)
        out = scratch(spark, f"model-{name}")
        w = stored(T.windows_for(tokens(spark, d), spec), "windows")
        _, fitted = T.fit_and_predict(w, spec)
        fitted.save(spark, out)
        found = M.load_model(spark, out).predict(w)
        return found.select(*IDS, "split", "token", "prediction", *[r(F.element_at("probabilities", k + 1), 4, f"p{k}") for k in range(K)])

    return run


QUERIES["logistic_predict"] = model_query("logistic")
QUERIES["boosted_predict"] = model_query("boosted")


def q_trained_inference(spark: SparkSession, d: str) -> DataFrame:
    """Training with all that it stores, then an answer for each series from the store."""
    out = scratch(spark, "trained")
    candles = stored(hourly(spark, d), "candles")
    T.train(candles, T.Spec("logistic", length=8), out, least_train=LEAST)
    said = T.infer_stored(candles, out)
    return said.select(*SERIES, "timestamp", "predicted_token", *[r(F.element_at("probabilities", k + 1), 4, f"p{k}") for k in range(K)], "action", r("confidence", 4), "model_version", "n_candles_used")


QUERIES["trained_inference"] = q_trained_inference


# Stores: written, and read again --------------------------------------------------------------------------------------

CLOSES = f"SELECT {SQL_IDS}, timeframe, open, high, low, close, volume FROM bars"
CLOSE_OUT = (*IDS, "timeframe", *PRICES, "volume")


@query(f"WITH {BARS} {CLOSES} WHERE ticker = (SELECT min(ticker) FROM bars)")
def q_folder_store(spark: SparkSession, d: str) -> DataFrame:
    """Bars stored by ticker and timeframe in a folder with a dot in its name, and those of one ticker loaded."""
    at, b = f"{scratch(spark, 'folder')}/raw.v1", bars_hourly(spark, d)
    first = save_candles(b, at).agg(F.min("ticker")).first()[0]
    return load_candles(spark, at, ticker=first, timeframe="1H").select(*CLOSE_OUT)


@query(f"WITH {BARS} {CLOSES}")
def q_csv_store(spark: SparkSession, d: str) -> DataFrame:
    """Bars as CSV under other names, found and read by the folder's files."""
    at, b = scratch(spark, "csv"), bars_hourly(spark, d)
    named = {"ticker": "Symbol", "timeframe": "interval", "begin": "Date", "open": "O", "high": "H", "low": "L", "close": "C", "volume": "Vol"}
    write_csv(b.select(*[F.col(k).alias(v) for k, v in named.items()]), at)
    return load_candles(spark, at).select(*CLOSE_OUT)


@query(f"WITH {BARS} {CLOSES}")
def q_candle_json(spark: SparkSession, d: str) -> DataFrame:
    """Bars as JSON objects with times in several layouts, decoded one by one."""
    h = F.hour("begin") % 3
    begin = F.when(h == 0, F.date_format("begin", "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(h == 1, F.date_format(F.col("begin") + F.expr("interval 3 hours"), "yyyy-MM-dd'T'HH:mm:ss'+03:00'")).otherwise(F.date_format("begin", "yyyy-MM-dd HH:mm:ss"))
    text = F.to_json(F.struct("ticker", "timeframe", begin.alias("begin"), F.lit("").alias("end"), *PRICES, "volume"))
    return bars_hourly(spark, d).select(B.decode_candle(text).alias("c")).select(*[F.col(f"c.{c}").alias(c) for c in CLOSE_OUT])


@query(f"{MARKOV}, twice AS (SELECT *, 'v1' AS model_version FROM pd WHERE split = 'val' UNION ALL SELECT *, 'v2' FROM pd WHERE split = 'test') SELECT {SQL_IDS}, model_version, CAST(prediction AS INT) AS prediction, {', '.join(rr(f'q{k}', 6, f'prob_class_{k}') for k in range(K))} FROM twice")
def q_prediction_log(spark: SparkSession, d: str) -> DataFrame:
    """Predictions of two versions appended one after the other, and read with a column a class."""
    at, p = scratch(spark, "predictions"), stored(predictions(spark, d), "predicted")
    for split, version in (("val", "v1"), ("test", "v2")):
        append_predictions(p.where(F.col("split") == split).select(*IDS, "prediction", "probabilities", F.lit(version).alias("model_version")), at)
    wide = probability_columns(load_predictions(spark, at), K)
    return wide.select(*IDS, "model_version", "prediction", *[r(f"prob_class_{k}") for k in range(K)])


@query(f"""{SCORED} SELECT CASE WHEN confidence IS NULL OR (act <> 'HOLD' AND reasons <> '') THEN 'HOLD' ELSE act END AS action, count(*) AS n FROM d7 GROUP BY 1""")
def q_decision_log(spark: SparkSession, d: str) -> DataFrame:
    """Decisions appended as JSON lines by a stream that ends, counted by what was decided."""
    at = scratch(spark, "decisions")
    Q.evaluate_decisions(requests(spark, d)).select(*IDS, "action", "score", "reason").write.parquet(f"{at}/in")
    made = spark.readStream.schema("ticker string, begin timestamp_ntz, action string, score double, reason string").parquet(f"{at}/in")
    ST.append_log(made, f"{at}/log", f"{at}/state").awaitTermination()
    return spark.read.schema("action string").json(f"{at}/log").groupBy("action").agg(F.count("*").alias("n"))


# Streams of bars ----------------------------------------------------------------------------------------------------


def streamed(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """Cleaned bars as a stream of files, and a folder for its results."""
    at = scratch(spark, "stream")
    hourly(spark, d).select(*CANDLE_COLUMNS).write.parquet(f"{at}/in")
    return ST.candle_stream(spark, f"{at}/in"), at


def finished(rows: DataFrame, at: str, name: str) -> DataFrame:
    """All that a stream gives for the files there are."""
    rows.writeStream.format("parquet").option("path", f"{at}/{name}").option("checkpointLocation", f"{at}/{name}-state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{at}/{name}")


@query(f"{IND} SELECT {SQL_IDS}, {rr('ema_20', 6, 'ema')} FROM ind")
def q_stream_ema(spark: SparkSession, d: str) -> DataFrame:
    rows, at = streamed(spark, d)
    return finished(ST.ema_stream(rows, 20), at, "ema").select("ticker", F.col("begin").cast("timestamp_ntz").alias("begin"), r("ema"))


def in_two_parts(spark: SparkSession, d: str, rows_of: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """What a stream gives for cleaned bars that come out of order: first the earlier half without the odd hours of its last twelve, but
    with the even hours of the twelve after it, then the rest, by a query that goes on from its checkpoint.
    """
    at, candles = scratch(spark, "parts"), stored(hourly(spark, d).select(*CANDLE_COLUMNS), "candles")
    ends = candles.agg(F.min("begin").alias("a"), F.max("begin").alias("b")).first()
    half, near, begin = ends["a"] + (ends["b"] - ends["a"]) / 2, dt.timedelta(hours=12), F.col("begin")
    early = (begin < F.lit(half - near)) | ((begin < F.lit(half + near)) & (F.hour("begin") % 2 == 0))
    for part in (early, ~early):
        candles.where(part).write.mode("append").parquet(f"{at}/in")
        found = finished(rows_of(ST.candle_stream(spark, f"{at}/in")), at, name)
    return found.withColumn("begin", F.col("begin").cast("timestamp_ntz"))


SETTLED = '"begin" < (SELECT max("begin") - INTERVAL 2 DAY FROM c)'


@query(f"""{IND} SELECT {SQL_IDS}, {', '.join(f'round("{c}", 6) + 0.0 AS "{c}"' for c in REAL)}, "hour", day_of_week, "month" FROM ind WHERE {SETTLED}""")
def q_stream_indicators(spark: SparkSession, d: str) -> DataFrame:
    """Indicators from kept state, of bars out of order and a stream that was stopped in between: those of all bars at once."""
    return in_two_parts(spark, d, lambda rows: feature_stream(rows, "2 days"), "features").select(*IDS, *[r(c) for c in REAL], "hour", "day_of_week", "month")


WIDTH = len(W.FEATURES)


def place_in_window(name: str) -> Column:
    """A feature's values in a flattened window, from the first row to the last."""
    return F.filter("window", lambda x, i: i % WIDTH == W.FEATURES.index(name))


@query(f"""{IND}, w0 AS (SELECT {SQL_IDS}, list(close) OVER fr AS closes, list(coalesce(volume_ratio, 0)) OVER fr AS ratios, count(*) OVER fr AS n FROM ind WINDOW fr AS ({OWN} ROWS BETWEEN {LENGTH - 1} PRECEDING AND CURRENT ROW))
 SELECT {SQL_IDS}, {LENGTH} AS steps, {rr('list_sum(closes)', 4, 'sum_close')}, {rr(f'list_sum(list_transform(range(1, {LENGTH + 1}), lambda i: i * closes[i]))', 3, 'weighed_close')}, {rr('list_sum(ratios)', 5, 'sum_ratio')} FROM w0 WHERE n = {LENGTH} AND {SETTLED}""")
def q_stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Model windows from kept state, one for each bar that the watermark has passed."""
    rows = in_two_parts(spark, d, lambda x: feature_stream(x, "2 days", LENGTH), "windows").where("window is not null")
    summed = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0)))
    closes = place_in_window("close")
    steps = (F.size("window") / WIDTH).cast("int").alias("steps")
    return rows.select(*IDS, steps, r(summed(closes), 4, "sum_close"), r(summed(F.transform(closes, lambda x, i: x * (i + 1))), 3, "weighed_close"), r(summed(place_in_window("volume_ratio")), 5, "sum_ratio"))



@query(f"WITH {BARS}, {GOOD} SELECT {SQL_IDS} FROM c")
def q_stream_copies(spark: SparkSession, d: str) -> DataFrame:
    """Each bar comes twice, in two files; one is kept."""
    rows, at = streamed(spark, d)
    hourly(spark, d).select(*CANDLE_COLUMNS).write.mode("append").parquet(f"{at}/in")
    return finished(ST.first_candles(rows, "100 days"), at, "once").select("ticker", F.col("begin").cast("timestamp_ntz").alias("begin"))


@query(f"""WITH {BARS}, {GOOD} SELECT p.ticker, p."begin" AS timestamp, CAST(hour(p."begin") % 7 AS INT) AS prediction, {rr('(c.close - p.close) / nullif(p.close, 0)', 6, 'actual_return')} FROM c p JOIN c ON c.ticker = p.ticker AND c."begin" = p."begin" + INTERVAL 3 HOUR""")
def q_stream_outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows, at = streamed(spark, d)
    said = rows.select("ticker", F.col("begin").alias("timestamp"), (F.hour("begin") % 7).alias("prediction"), "close")
    found = finished(ST.outcome_stream(said, ST.candle_stream(spark, f"{at}/in"), 3, "100 days"), at, "outcomes")
    return found.select("ticker", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "prediction", r("actual_return"))


# Batches that are stored, again and overlapping, or rejected -----------------------------------------------------------

SCALED = ", ".join(f"{c} * f AS {c}" for c in PRICES)
#: Bars stored once, again at 1.01 of their prices, and the later half once more at 1.02.
RESTORED = f"""{BARS}, mid AS (SELECT min("begin") + (max("begin") - min("begin")) / 2 AS half FROM bars), scaled AS (SELECT bars.*, CASE WHEN "begin" >= half THEN 1.02 ELSE 1.01 END::DOUBLE AS f FROM bars CROSS JOIN mid),
 restored AS (SELECT ticker, timeframe, "begin", "end", {SCALED}, volume, value, source FROM scaled)"""


def restored(spark: SparkSession, d: str) -> DataFrame:
    """All that is in the store afterwards, copies too."""
    at, b = scratch(spark, "again"), stored(bars_hourly(spark, d), "bars")
    ends = b.agg(F.min("begin").alias("a"), F.max("begin").alias("b"))
    late = b.join(F.broadcast(ends)).where(F.col("begin") >= F.col("a") + (F.col("b") - F.col("a")) / 2).drop("a", "b")
    for rows, f in ((b, 1.0), (b, 1.01), (late, 1.02)):
        save_candles(rows.withColumns({c: F.col(c) * f for c in PRICES}), at)
    return load_candles(spark, at)


@query(f"""WITH {RESTORED} SELECT ticker, "begin", {', '.join(rr(c, 4) for c in PRICES)}, copies FROM restored JOIN (SELECT "begin", CASE WHEN "begin" >= half THEN 2 ELSE 1 END::BIGINT AS copies FROM (SELECT DISTINCT "begin" FROM bars) CROSS JOIN mid) USING ("begin") WHERE NOT ({INVALID})""")
def q_stored_again(spark: SparkSession, d: str) -> DataFrame:
    """A batch stored again replaces itself; of overlapping batches the candle stored last is kept by cleaning."""
    rows = stored(restored(spark, d), "restored")
    copies = rows.groupBy("ticker", "begin").agg(F.count("*").alias("copies"))
    return C.clean_candles(rows).join(copies, ["ticker", "begin"]).select(*IDS, *[r(c, 4) for c in PRICES], "copies")


AGAIN = f"WITH {RESTORED}, {GOOD.replace('FROM bars', 'FROM restored')}, {indicators_sql()}"


@query(f"{AGAIN} SELECT {SQL_IDS}, {', '.join(rr(c) for c in ('return_1', 'return_3', 'rolling_volatility', 'ema_20_distance', 'volume_ratio'))} FROM ind")
def q_stored_indicators(spark: SparkSession, d: str) -> DataFrame:
    """Indicators of what was stored more than once: a copy is no candle of its own."""
    return W.with_indicators(C.clean_candles(restored(spark, d))).select(*IDS, *[r(c) for c in ("return_1", "return_3", "rolling_volatility", "ema_20_distance", "volume_ratio")])


#: One batch a ticker and day, with a fault that hangs on the day: none, a price, high below low, no volume, an overlap, a second begin, a ticker.
SPOILED = f"""{BARS}, numbered AS (SELECT ticker AS batch, CAST("begin" AS DATE) AS day, CAST(row_number() OVER (PARTITION BY ticker, CAST("begin" AS DATE) ORDER BY "begin" DESC) - 1 AS BIGINT) AS nr, dayofmonth("begin") % 7 AS k, hour("begin") AS h, * FROM bars),
 spoiled AS (SELECT batch, day, nr, CASE WHEN k = 6 AND h = 15 THEN 'OTHER' ELSE ticker END AS ticker, timeframe, CASE WHEN k = 5 AND h = 13 THEN "begin" - INTERVAL 1 HOUR ELSE "begin" END AS "begin", CASE WHEN k = 4 AND h = 11 THEN "end" + INTERVAL 90 MINUTE ELSE "end" END AS "end",
 CASE WHEN k = 1 AND h IN (5, 8) THEN -open ELSE open END AS open, CASE WHEN k = 2 AND h = 7 THEN low - 1 ELSE high END AS high, low, CASE WHEN k = 1 AND h = 6 THEN NULL ELSE close END AS close, CASE WHEN k = 3 AND h = 9 THEN 0 ELSE volume END AS volume, value, source FROM numbered)"""
GATED = f"""{SPOILED}, looked AS (SELECT *, CASE WHEN "begin" IS NULL THEN 'no begin' WHEN least(coalesce(open, 0), coalesce(high, 0), coalesce(low, 0), coalesce(close, 0)) <= 0 THEN 'price not positive' WHEN high < low THEN 'high below low' WHEN coalesce(volume, 0) <= 0 THEN 'volume not positive' END AS own,
 CASE WHEN first_value(ticker) OVER w <> ticker THEN 'several tickers' WHEN first_value(timeframe) OVER w <> timeframe THEN 'several timeframes' WHEN lag("begin") OVER w = "begin" THEN 'duplicate begin' WHEN lag("end") OVER w > "begin" THEN 'overlaps the candle before' END AS other, row_number() OVER w - 1 AS spot
 FROM spoiled WINDOW w AS (PARTITION BY batch, day ORDER BY "begin", nr)),
 verdict AS (SELECT batch, day, min(nr) FILTER (WHERE own IS NOT NULL) AS own_row, arg_min(own, nr) FILTER (WHERE own IS NOT NULL) AS own_rule, min(spot) FILTER (WHERE other IS NOT NULL) AS other_row, arg_min(other, spot) FILTER (WHERE other IS NOT NULL) AS other_rule, count(*) AS n FROM looked GROUP BY batch, day)"""


def spoiled(spark: SparkSession, d: str) -> DataFrame:
    c, day = F.col, F.to_date("begin")
    b = bars_hourly(spark, d).withColumns({"batch": c("ticker"), "day": day, "k": F.dayofmonth("begin") % 7, "h": F.hour("begin")})
    b = b.withColumn("nr", F.row_number().over(Window.partitionBy("batch", "day").orderBy(F.desc("begin"))).cast("long") - 1)
    at = lambda k, *hours: (c("k") == k) & c("h").isin(*hours)
    return b.select(
        "batch", "day", "nr", F.when(at(6, 15), "OTHER").otherwise(c("ticker")).alias("ticker"), "timeframe", F.when(at(5, 13), c("begin") - F.expr("interval 1 hour")).otherwise(c("begin")).alias("begin"),
        F.when(at(4, 11), c("end") + F.expr("interval 90 minutes")).otherwise(c("end")).alias("end"), F.when(at(1, 5, 8), -c("open")).otherwise(c("open")).alias("open"), F.when(at(2, 7), c("low") - 1).otherwise(c("high")).alias("high"),
        "low", F.when(~at(1, 6), c("close")).alias("close"), F.when(at(3, 9), 0.0).otherwise(c("volume")).alias("volume"), "value", "source",
    )


@query(f"WITH {GATED} SELECT batch, day, n, coalesce(own_row, other_row) AS rejected_row, coalesce(own_rule, other_rule) AS rejected_rule FROM verdict")
def q_batch_gate(spark: SparkSession, d: str) -> DataFrame:
    """For each batch whether it may be stored: if not, the first violation and its row."""
    return C.gated(spoiled(spark, d), ("batch", "day"), "nr").groupBy("batch", "day", "rejected_row", "rejected_rule").agg(F.count("*").alias("n"))


@query(f"""WITH {GATED} SELECT l.ticker, "begin", {rr('close', 4)}, volume FROM looked l JOIN verdict v USING (batch, day) WHERE own_rule IS NULL AND other_rule IS NULL""")
def q_gated_store(spark: SparkSession, d: str) -> DataFrame:
    """Batches as a stream: the fit ones stored, and stored once though the stream runs again from the start."""
    at, rows = scratch(spark, "gate"), spoiled(spark, d)
    rows.repartition("batch", "day").write.parquet(f"{at}/in")
    for run in range(2):
        ST.store_stream(spark.readStream.schema(rows.schema).parquet(f"{at}/in"), f"{at}/store", f"{at}/rejects", f"{at}/state-{run}", ("batch", "day"), "nr").awaitTermination()
    return stored_candles(spark, f"{at}/store").select(*IDS, r("close", 4), "volume")


# The paged source, from a mirror of pages made of bars ------------------------------------------------------------------

PER_PAGE, RANGE = 24, 4


def mirror(spark: SparkSession, d: str) -> tuple[str, dict[str, str]]:
    """A mirror of pages of bars, in ranges of four days: pages are full, the last one of a range may be short or missing."""
    at, b = scratch(spark, "mirror"), stored(bars_hourly(spark, d), "bars")
    ends = b.agg(F.to_date(F.min("begin")).alias("a"), F.to_date(F.max("begin")).alias("b"), F.array_join(F.sort_array(F.collect_set("ticker")), ",").alias("t")).first()
    cols = ["begin", "end", "open", "close", "high", "low", "value", "volume"]
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") if c in ("begin", "end") else F.col(c).cast("string")
    day = F.date_add(F.lit(ends["a"]), (F.floor(F.date_diff(F.to_date("begin"), F.lit(ends["a"])) / RANGE) * RANGE).cast("int"))
    place = F.row_number().over(Window.partitionBy("ticker", "first").orderBy("begin")) - 1
    rows = b.withColumn("first", day).withColumn("start", (F.floor(place / PER_PAGE) * PER_PAGE).cast("int"))
    block = F.to_json(F.struct(F.struct(F.array(*map(F.lit, cols)).alias("columns"), F.sort_array(F.collect_list(F.array(*map(text, cols)))).alias("data")).alias("candles")))
    save_pages(rows.groupBy("ticker", F.col("first").alias("begin"), "start").agg(block.alias("json")), at)
    return at, {"tickers": ends["t"], "timeframe": "1H", "from": str(ends["a"]), "till": str(ends["b"]), "range_days": str(RANGE), "page": str(PER_PAGE), "mirror": "yes"}


PAGED = f'SELECT ticker, "begin", "end", {", ".join(rr(c, 4) for c in PRICES)}, volume'


@query(f"WITH {BARS} {PAGED} FROM bars")
def q_paged_candles(spark: SparkSession, d: str) -> DataFrame:
    """Candles of a paged source: a partition for each ticker and range of days, pages followed within it."""
    at, o = mirror(spark, d)
    own = {k: v for k, v in o.items() if k not in ("tickers", "timeframe", "from", "till")}
    found = R.fetch_candles(spark, at, o["tickers"].split(","), "1H", o["from"], o["till"], **own)
    return found.select(*IDS, "end", *[r(c, 4) for c in PRICES], "volume")


@query(f"""WITH {BARS} {PAGED} FROM bars WHERE "begin" < (SELECT max("begin") - INTERVAL 5 HOUR FROM bars)""")
def q_paged_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same as a stream that goes on from its checkpoint: up to a time in the middle, then up to one near the end."""
    at, o = mirror(spark, d)
    spark.dataSource.register(R.PagedSource)
    ends = bars_hourly(spark, d).agg(F.min("begin").alias("a"), F.max("begin").alias("b")).first()
    out, path = scratch(spark, "polled"), at.removeprefix("file://").removeprefix("file:")
    for until in (ends["a"] + (ends["b"] - ends["a"]) / 2, ends["b"] - dt.timedelta(hours=5)):
        Path(path, "_clock").write_text(until.strftime("%Y-%m-%d %H:%M:%S"))
        rows = spark.readStream.format("paged_json").options(url=at, clock=f"{at}/_clock", **o).load()
        rows.writeStream.format("parquet").option("path", f"{out}/pages").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    pages = spark.read.schema("ticker string, page int, json string").parquet(f"{out}/pages")
    return B.decode_blocks(pages.select("ticker", "json")).select(*IDS, "end", *[r(c, 4) for c in PRICES], "volume")


# The research grid -------------------------------------------------------------------------------------------------------

CELLS = [(k, h, n) for k in (3, 5) for h in (1, 3) for n in (8, 16)]


def cell_sql(k: int, h: int, n: int) -> str:
    """The majority's scores for one cell; tokens by edges of all series together."""
    name = f"{k}_{h}_{n}"
    f1 = f"SELECT split, avg(f1) AS f1 FROM (SELECT l.split, l.c, coalesce(2.0 * count(*) FILTER (WHERE token = l.c AND best = l.c) / nullif(count(*) FILTER (WHERE token = l.c) + count(*) FILTER (WHERE best = l.c), 0), 0) AS f1 FROM (SELECT split, token AS c FROM p_{name} UNION SELECT split, best FROM p_{name}) l JOIN p_{name} p USING (split) GROUP BY l.split, l.c) GROUP BY split"
    return f"""mv_{name} AS (SELECT *, (lead(close, {h}) OVER w - close) / CASE WHEN abs(atr) < 1e-8 THEN 1e-8 ELSE atr END AS move, lead(close, {h}) OVER w / nullif(close, 0) - 1 AS forward_return, row_number() OVER w AS i FROM ind WHERE split IS NOT NULL WINDOW w AS (PARTITION BY ticker, timeframe, split ORDER BY "begin")),
 ed_{name} AS (SELECT quantile_cont(move, [{', '.join(repr(j / k) for j in range(k + 1))}]) AS edges FROM mv_{name} WHERE split = 'train'),
 tk_{name} AS (SELECT mv_{name}.*, greatest(0, least({k - 1}, len(list_filter(edges, lambda e: e <= move)) - 1)) AS token FROM mv_{name} CROSS JOIN ed_{name} WHERE move IS NOT NULL AND i >= {n}),
 best_{name} AS (SELECT token AS best FROM tk_{name} WHERE split = 'train' GROUP BY token ORDER BY count(*) DESC, token LIMIT 1), p_{name} AS (SELECT * FROM tk_{name} CROSS JOIN best_{name}), f_{name} AS ({f1}),
 a_{name} AS (SELECT split, avg(CASE WHEN sign(best - {k // 2}) = sign(token - {k // 2}) THEN 1.0 ELSE 0.0 END) AS a FROM p_{name} WHERE forward_return IS NOT NULL GROUP BY split),
 r_{name} AS (SELECT {k} AS n_classes, {h} AS horizon, {n} AS length, {', '.join(f"round((SELECT f1 FROM f_{name} WHERE split = '{x}'), 6) + 0.0 AS {x}_macro_f1, round((SELECT a FROM a_{name} WHERE split = '{x}'), 6) + 0.0 AS {x}_action_accuracy" for x in ('val', 'test'))})"""


@query(f"{SPLIT}, {', '.join(cell_sql(*c) for c in CELLS)} {' UNION ALL '.join(f'SELECT * FROM r_{k}_{h}_{n}' for k, h, n in CELLS)}")
def q_research_grid(spark: SparkSession, d: str) -> DataFrame:
    """Cells of a grid that share indicators, moves, tokens and windows; half of them done before, and read from the ledger."""
    ledger, specs = f"{scratch(spark, 'grid')}/ledger", [T.Spec("majority", k, h, n) for k, h, n in CELLS]
    candles = stored(hourly(spark, d), "candles")
    T.research(spark, candles, specs[: len(specs) // 2], LEAST, ledger)
    found = T.research(spark, candles, specs, LEAST, ledger)
    return found.select("n_classes", "horizon", "length", *[r(f"{x}_{c}") for x in ("val", "test") for c in ("macro_f1", "action_accuracy")])
