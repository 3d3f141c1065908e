"""Candle files, synthetic candles, and bars built from the test tables."""

from __future__ import annotations

import json
import warnings

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.clean import normalize_columns, normalize_times
from ..session import CANDLES, INGESTED, SERIES

FORMATS = ("parquet", "csv")
#: The partition column that tells stored batches apart.
BATCH = "stored_batch"
#: What `with_provenance` tells of a row.
PROVENANCE = "struct<stored: timestamp, file: string, block: bigint, row: bigint>"


def holds(spark: SparkSession, path: str, pattern: str) -> bool:
    """Whether a folder has paths of a pattern, in any store that Spark reaches."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return len(fs.globStatus(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, pattern)) or ()) > 0


def suffix_of(spark: SparkSession, path: str) -> str:
    """parquet or csv: by the path's own ending, else parquet if the folder, or one of its partitions' folders, has such a file, else csv."""
    if (ending := path.rsplit(".", 1)[-1].lower()) in FORMATS:
        return ending
    return "parquet" if any(holds(spark, path, "*=*/" * depth + "*.parquet") for depth in range(4)) else "csv"


def read_file(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    format = format or suffix_of(spark, path)
    if format not in FORMATS:
        raise ValueError(f"unsupported format: {format}")
    reader = spark.read.option("header", True).option("inferSchema", True) if format == "csv" else spark.read
    return with_provenance(reader.format(format).load(path))


def with_provenance(scan: DataFrame) -> DataFrame:
    """A scan with where each row was found, which orders rows by when they were stored: files by their time, rows of a file by place.
    A column of that name is replaced.
    """
    at = F.struct(F.col("_metadata.file_modification_time").alias("stored"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return scan.withColumn(INGESTED, at)


def is_folder(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(target) and fs.getFileStatus(target).isDirectory()


def file_ledger(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """(path, n_rows) of each file of one format in a folder; 0 for corrupt ones and for empty ones. No column is read for it: of a
    Parquet file the footer says how many rows there are.
    """
    format = format or suffix_of(spark, path)
    option = {"pathGlobFilter": f"*.{format}", "recursiveFileLookup": True}
    files = spark.read.format("binaryFile").options(**option).load(path).select("path")
    rows = spark.read.schema("_any string").option("ignoreCorruptFiles", True).options(**option).options(**({"header": True} if format == "csv" else {})).format(format).load(path)
    plain = lambda c: F.regexp_replace(F.url_decode(F.regexp_replace(c, "[+]", "%2B")), "^file:/*", "/")
    read = rows.select(F.col("_metadata.file_path").alias("f")).groupBy("f").agg(F.count("*").alias("n_rows")).select(plain("f").alias("k"), "n_rows")
    return files.withColumn("k", plain("path")).join(read, "k", "left").select("path", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def read_directory(spark: SparkSession, path: str, format: str | None = None) -> DataFrame:
    """All files of one format in a folder, by column name, with where each row was found. Files that cannot be read are skipped with a
    warning that counts them and names the first; none at all is an error. `file_ledger` has them all.
    """
    format = format or suffix_of(spark, path)
    reader = spark.read.option("pathGlobFilter", f"*.{format}").option("ignoreCorruptFiles", True)
    reader = reader.option("header", True).option("inferSchema", True) if format == "csv" else reader.option("mergeSchema", True)
    found = reader.format(format).load(path)
    if format == "parquet":
        lost = file_ledger(spark, path, format).where("n_rows = 0").agg(F.count("*").alias("n"), F.min("path").alias("some")).first()
        if lost["n"]:
            warnings.warn(f"{lost['n']} files of {path} gave no rows, {lost['some']} the first", stacklevel=2)
    return with_provenance(found)


def load_candles(spark: SparkSession, path: str, ticker: str | None = None, timeframe: str | None = None, format: str | None = None) -> DataFrame:
    """Candles of a file or folder with normal names and times, of one ticker and timeframe if asked. Filters reach the scan. Copies
    are all there, with where each was found (INGESTED), by which `clean_candles` keeps the last.
    """
    try:
        df = normalize_columns(read_directory(spark, path, format) if is_folder(spark, path) else read_file(spark, path, format))
    except AnalysisException as e:
        raise ValueError(f"no candles at {path}: {e}") from e
    for name, value in (("ticker", ticker), ("timeframe", timeframe)):
        if value is not None:
            if name not in df.columns:
                raise ValueError(f"no column {name} to filter by")
            df = df.where(F.col(name) == value)
    if df.isEmpty():
        raise ValueError(f"no candles at {path} for {ticker}, {timeframe}")
    return normalize_times(df).drop(BATCH)


def stored_candles(spark: SparkSession, path: str) -> DataFrame:
    """All candles of a folder of `save_candles`, as `load_candles` gives them. Where it stored no batch, as when a gate let none pass, there
    are none; a folder that is not there is an error.
    """
    if is_folder(spark, path) and not holds(spark, path, "*=*/" * len((*SERIES, BATCH)) + "*.parquet"):
        return spark.createDataFrame([], CANDLES).withColumn(INGESTED, F.lit(None).cast(PROVENANCE))
    return load_candles(spark, path)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name; columns that one lacks are null there."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def candles_of(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """A table of candles given as dictionaries, with synonyms of names, times as texts, and value where it is missing."""
    df = normalize_times(normalize_columns(spark.createDataFrame(rows)))
    return df.withColumn("value", F.col("close") * F.col("volume")) if "value" not in df.columns else df


def mock_candles(spark: SparkSession, n: int = 100, ticker: str = "SBER", timeframe: str = "1H", start: float = 250.0, volatility: float = 0.01, seed: int = 42) -> DataFrame:
    """Random-walk candles from 2024-01-01 for fixtures of bounded size, the same for the same seed."""
    draw = np.random.RandomState(seed)
    #: The kinds of draws and their order.
    drawn = [draw.normal(0, volatility, n), draw.uniform(0, volatility, n), draw.uniform(0, volatility, n), draw.lognormal(0, 0.5, n)]
    rows = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(zip(*drawn, strict=True))], "i int, move double, above double, below double, size double")
    step = F.expr("interval 1 day" if timeframe == "1D" else "interval 1 hour")
    c = F.col
    walk = F.product(1 + c("move")).over(Window.partitionBy(F.lit(0)).orderBy("i"))
    begin = F.expr("timestamp_ntz'2024-01-01'") + step * c("i")
    rows = rows.withColumns({"open": start * walk, "begin": begin}).withColumn("close", c("open") * (1 + c("move")))
    rows = rows.withColumns({"end": c("begin") + step, "high": F.greatest("open", "close") + c("above") * c("open"), "low": F.least("open", "close") - c("below") * c("open"), "volume": 1e6 * c("size")})
    named = {"ticker": F.lit(ticker), "timeframe": F.lit(timeframe), "value": c("close") * c("volume"), "source": F.lit("mock")}
    return rows.withColumns(named).select(*[c(f.name).cast(f.dataType) for f in CANDLES])


def bars_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of each type of event: partial aggregation by hour, then one shuffle of bars."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    hour = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return bars(e.select(F.col("event_type").alias("ticker"), hour.alias("begin"), "ts", F.col("value").alias("price")), "ts", "1H", F.expr("interval 1 hour"), "events")


def bars_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each priority of orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    day = F.date_trunc("day", F.col("o_orderdate")).cast("timestamp_ntz")
    return bars(o.select(F.col("o_orderpriority").alias("ticker"), day.alias("begin"), "o_orderkey", F.col("o_totalprice").alias("price")), "o_orderkey", "1D", F.expr("interval 1 day"), "orders")


def bars(ticks: DataFrame, order: str, timeframe: str, length, source: str) -> DataFrame:
    """Bars of ticks (ticker, begin, price), first and last by order."""
    return ticks.groupBy("ticker", F.lit(timeframe).alias("timeframe"), "begin").agg(
        (F.min_by("price", order)).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.count("*").cast("double").alias("volume"), F.sum("price").alias("value")
    ).select(*SERIES, "begin", (F.col("begin") + length).alias("end"), "open", "high", "low", "close", "volume", "value", F.lit(source).alias("source"))


def load_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_json_document(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)
