"""Session settings and the candle schema that all operators share."""

from __future__ import annotations

import json
import tempfile
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: One series (ordered by begin; columns that name a split may be added), and the columns of stored candles.
SERIES = ("ticker", "timeframe")
CANDLE_COLUMNS = ("ticker", "timeframe", "begin", "end", "open", "high", "low", "close", "volume", "value", "source")
PRICES = ("open", "high", "low", "close")
#: Where `load_candles` found a row: time, name and block of its file, and its place. Later ones are greater.
INGESTED = "ingested"

CANDLES = T.StructType(
    [T.StructField("ticker", T.StringType()), T.StructField("timeframe", T.StringType()), T.StructField("begin", T.TimestampNTZType()), T.StructField("end", T.TimestampNTZType())]
    + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "value")]
    + [T.StructField("source", T.StringType())]
)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared one (spark.checkpoint.dir), removed when the application ends. Only a local session may
    do without that setting: it gets a temporary folder.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="barloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/barloom/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df as a table in a scratch folder, for results that several jobs read."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_document(spark: SparkSession, x: Any, path: str) -> None:
    """A small document (settings, figures, parameters of a model) as JSON, in any store that Spark reaches. Replaces what is there."""
    spark.createDataFrame([(json.dumps(x, indent=2, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str) -> Any:
    return json.loads(spark.read.text(path, wholetext=True).first()["value"])


def session(name: str = "barloom", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; nanosecond Parquet timestamps come as numbers, which the readers convert."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.legacy.parquet.nanosAsLong": "true"}
    return SparkSession.builder.appName(name).config(map=base | settings).getOrCreate()
