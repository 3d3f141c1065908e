"""Candles in JSON: blocks of columns and rows, and single objects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import flexible_time, lenient_double
from ..session import PRICES

BLOCK = "struct<candles: struct<columns: array<string>, data: array<array<string>>>>"
#: Columns that a block must have.
BLOCK_COLUMNS = (*PRICES, "value", "volume", "begin", "end")


def decode_blocks(df: DataFrame, json: str = "json") -> DataFrame:
    """A row per candle of JSON blocks, whose columns may come in any order; numbers may be texts. A block that lacks a column
    stops the job with the column's name. Other columns of df stay.
    """
    df = df.withColumn("_b", F.from_json(json, BLOCK)["candles"])
    for c in BLOCK_COLUMNS:
        lacks = F.col("_b").isNotNull() & ~F.coalesce(F.array_contains("_b.columns", c), F.lit(False))
        df = df.withColumn("_b", F.when(lacks, F.raise_error(F.lit(f"block lacks column {c}"))).otherwise(F.col("_b")))
    names = F.col("_b.columns")
    rows = df.select(*[c for c in df.columns if c not in ("_b", json)], names.alias("_n"), F.explode("_b.data").alias("_d"))
    at = lambda c: F.try_element_at("_d", F.array_position("_n", c).cast("int"))
    return rows.select("*", *[lenient_double(at(c)).alias(c) for c in (*PRICES, "value", "volume")], flexible_time(at("begin")).alias("begin"), flexible_time(at("end")).alias("end")).drop("_n", "_d")


CANDLE = "ticker string, timeframe string, begin string, end string, open double, high double, low double, close double, volume double, value double, source string"
NEWS = "timestamp string, title string, summary string, sentiment string"
SIGNAL = "direction string, strength double, confidence double, key_factors array<string>, risk_flags array<string>, horizon string, provider string, timestamp string"


def decode_candle(json: str | Column) -> Column:
    """A candle object as a struct; begin and end are times in any known layout, a blank end is missing."""
    x = F.from_json(json, CANDLE, {"mode": "FAILFAST"})
    return x.withField("begin", flexible_time(x["begin"])).withField("end", flexible_time(F.nullif(F.trim(x["end"]), F.lit(""))))


def decode_news(json: str | Column) -> Column:
    x = F.from_json(json, NEWS, {"mode": "FAILFAST"})
    return x.withField("timestamp", flexible_time(x["timestamp"]))


def decode_signal(json: str | Column) -> Column:
    x = F.from_json(json, SIGNAL, {"mode": "FAILFAST"})
    return x.withField("timestamp", flexible_time(x["timestamp"]))
