"""Where candles, predictions, decisions, reports and artifacts go."""

from __future__ import annotations

import json
import os
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import batch_stamp
from ..operators.clean import batch_summary
from ..session import SERIES
from .files import BATCH


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json_document(x: Any, path: str) -> None:
    """A small document, on the driver."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(x, f, indent=2, ensure_ascii=False, default=str)


def save_candles(df: DataFrame, path: str) -> DataFrame:
    """Stored by ticker, timeframe and batch, so that filters on them skip files; the summary of what was stored.

    A batch is what is stored of a series at once, and is named by its first and last begin: storing it again replaces it, all
    other batches stay. Its files are written aside and moved into place when all tasks are done; a reader between the removal of the old
    ones and that move finds neither. Batches that overlap are both there; `clean_candles` keeps the candle that was stored last.
    """
    name = F.concat_ws("_", batch_stamp(F.min("begin")), batch_stamp(F.max("begin")))
    names = df.groupBy(*SERIES).agg(name.alias(BATCH)).select(*[F.col(c).alias(f"_{c}") for c in SERIES], BATCH)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in SERIES]
    named = df.join(names, same).drop(*[f"_{c}" for c in SERIES])
    named.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*SERIES, BATCH).parquet(path)
    return batch_summary(df).withColumn("path", F.lit(path))


def save_pages(pages: DataFrame, path: str) -> None:
    """Raw pages (ticker, begin, start, json) as a mirror that the paged source can read: one file for each page, under the ticker, the
    first day of its range and its first row. Storing a page again replaces it.
    """
    rows = pages.select("ticker", F.col("begin").cast("string").alias("from"), "start", "json")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("ticker", "from", "start").text(path)


def append_decisions(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def append_predictions(df: DataFrame, path: str) -> None:
    """Appended, whatever was there stays as it is; probabilities stay one array."""
    df.write.mode("append").parquet(path)


def probability_columns(df: DataFrame, n_classes: int) -> DataFrame:
    """probabilities as columns prob_class_0 and on, for readers that want them so."""
    return df.select("*", *[F.try_element_at("probabilities", F.lit(k + 1)).alias(f"prob_class_{k}") for k in range(n_classes)]).drop("probabilities")


def save_report(df: DataFrame, path: str, without: tuple[str, ...] = ("equity_curve", "signals", "strategy_returns")) -> None:
    """A result of one row as a document, without its curves."""
    row = df.drop(*without).first()
    write_json_document(row.asDict(recursive=True) if row else {"error": "empty"}, path)
