"""What a service would answer, as functions of DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import batch_violations, mixed_batches, with_defaults
from ..operators.decide import DecisionConfig, evaluate_decisions
from ..session import CANDLE_COLUMNS
from ..sources.blocks import decode_blocks
from ..sources.rest import PagedSource
from ..sources.sinks import save_candles


def prepare(candles: DataFrame, batch: tuple[str, ...] = ()) -> DataFrame:
    """Candles with defaults; an error names the first violation of the batch."""
    df = with_defaults(candles)
    if batch and (mixed := mixed_batches(df, batch).first()):
        raise ValueError(f"several tickers or timeframes in one batch: {mixed.asDict()}")
    bad = batch_violations(df, batch).where(F.size("violations") > 0).select("ticker", "begin", "violations").first()
    if bad:
        raise ValueError(f"candle {bad['ticker']} {bad['begin']}: {', '.join(bad['violations'])}")
    return df


def store_candles(candles: DataFrame, path: str, batch: tuple[str, ...] = ()) -> DataFrame:
    return save_candles(prepare(candles, batch).select(*CANDLE_COLUMNS), path)


def raw_pages(spark: SparkSession, url: str, tickers: list[str], **options: str) -> DataFrame:
    """(ticker, page, json) of any resource: candles, security, orderbook, trades, sitenews, dataset and the named ones."""
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged_json").options(url=url, tickers=",".join(tickers), **options).load()


def fetch_candles(spark: SparkSession, url: str, tickers: list[str], timeframe: str, begin: str, end: str, **options: str) -> DataFrame:
    """Candles of a paged source."""
    found = raw_pages(spark, url, tickers, timeframe=timeframe, till=end, **{"from": begin}, **options)
    return decode_blocks(found.select("ticker", "json")).withColumns({"timeframe": F.lit(timeframe), "source": F.lit("paged_json")}).select(*CANDLE_COLUMNS)


def decide(requests: DataFrame, cfg: DecisionConfig = DecisionConfig()) -> DataFrame:
    return evaluate_decisions(requests, cfg)
