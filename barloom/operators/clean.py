"""Names, defaults, validation and cleaning of candles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import no_nan, timeframe_interval
from ..session import INGESTED, PRICES, SERIES

#: Other names of columns, after lowering and trimming.
SYNONYMS = {"timestamp": "begin", "datetime": "begin", "time": "begin", "date": "begin", "o": "open", "h": "high", "l": "low", "c": "close", "v": "volume", "vol": "volume", "tic": "ticker", "symbol": "ticker", "tf": "timeframe", "interval": "timeframe"}
REQUIRED = ("ticker", "timeframe", "begin", *PRICES, "volume")


def normalize_columns(df: DataFrame) -> DataFrame:
    """Lowered, trimmed names with synonyms replaced. Two columns of one name are an error."""
    names = [SYNONYMS.get(c.strip().lower(), c.strip().lower()) for c in df.columns]
    if len(set(names)) < len(names):
        raise ValueError(f"columns {df.columns} become {names}")
    return df.toDF(*names)


def missing_columns(df: DataFrame, strict: bool = False) -> list[str]:
    """Required columns that are not there; an error if strict. Rows are never dropped for it."""
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing and strict:
        raise ValueError(f"missing columns: {missing}")
    return missing


def with_defaults(df: DataFrame, ticker: str = "SBER", timeframe: str = "1H", source: str = "unknown") -> DataFrame:
    """Blank names filled in; end from the timeframe where it is missing; value as close * volume where it is missing or 0."""
    named = {c: F.coalesce(F.when(F.trim(c) != "", F.col(c)), F.lit(d)) for c, d in (("ticker", ticker), ("timeframe", timeframe), ("source", source))}
    df = df.withColumns(named)
    return df.withColumns({"end": F.coalesce("end", F.col("begin") + timeframe_interval("timeframe")), "value": derived_value()})


def derived_value() -> Column:
    return F.coalesce(F.when(F.col("value") != 0, F.col("value")), F.col("close") * F.col("volume"))


def normalize_times(df: DataFrame, zone: str | None = None) -> DataFrame:
    """begin and end as wall-clock times: of UTC, or of a zone. Numbers are nanoseconds."""
    for c in ("begin", "end"):
        if c not in df.columns:
            continue
        kind, t = df.schema[c].dataType, F.col(c)
        if isinstance(kind, T.LongType):
            t = F.timestamp_micros((t / 1000).cast("long"))
        elif isinstance(kind, T.StringType):
            t = F.try_to_timestamp(t)
        elif isinstance(kind, T.TimestampNTZType):
            t = t if zone is None else F.convert_timezone(F.lit("UTC"), F.lit(zone), t)
            df = df.withColumn(c, t)
            continue
        utc = F.convert_timezone(F.current_timezone(), F.lit(zone or "UTC"), t.cast("timestamp").cast("timestamp_ntz"))
        df = df.withColumn(c, utc)
    return df


def dedup_keep_last(df: DataFrame, keys: tuple[str, ...] = (*SERIES, "begin"), order: tuple[str, ...] = ("ingest",)) -> DataFrame:
    """The last row by order of each key: greatest struct in a partial aggregation, so a key with many copies is no burden."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order])) if rest else None
    return df.groupBy(*keys).agg(last.alias("_r")).select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def rules() -> dict[str, Column]:
    """The four faults that make a candle invalid; nulls are no fault here."""
    o, h, low, c = (F.col(x) for x in PRICES)
    fault = {
        "high_below_low": h < low,
        "not_positive": (o <= 0) | (h <= 0) | (low <= 0) | (c <= 0),
        "high_below_body": h < F.greatest(o, c),
        "low_above_body": low > F.least(o, c),
    }
    return {k: F.coalesce(v, F.lit(False)) for k, v in fault.items()}


def invalid() -> Column:
    return reduce(lambda a, b: a | b, rules().values())


def invalid_counts(df: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """How many rows break each rule, by series."""
    return df.groupBy(*keys).agg(*[F.count_if(v).alias(k) for k, v in rules().items()], F.count_if(invalid()).alias("invalid"), F.count("*").alias("n"))


def drop_missing(df: DataFrame) -> DataFrame:
    """Rows with all of the prices and the volume that the table has; NaN counts as missing."""
    there = [c for c in (*PRICES, "volume") if c in df.columns]
    return df.withColumns({c: no_nan(c) for c in there}).dropna("any", subset=there)


def clean_candles(df: DataFrame, drop: bool = True, order: tuple[str, ...] | None = None) -> DataFrame:
    """Last of duplicates, then invalid rows out (or flagged), then rows with missing values out. In this order: a bad copy that
    came last takes the place of a good one.

    Last is by the given columns; else by where `load_candles` found a row, so that what was stored later wins; else by the
    rows' order in the table. Where it was found is not handed on.
    """
    order = order or ((INGESTED,) if INGESTED in df.columns else None)
    if order:
        df = dedup_keep_last(df, order=order)
    else:
        df = dedup_keep_last(df.withColumn("_place", F.monotonically_increasing_id()), order=("_place",)).drop("_place")
    df = df.where(~invalid()) if drop else df.withColumn("invalid", invalid())
    return drop_missing(df).drop(INGESTED)


def batch_violations(df: DataFrame, batch: tuple[str, ...] = ()) -> DataFrame:
    """What makes a batch of candles unfit to be stored, row by row; any row with a violation rejects its batch.

    A batch is the whole table's series unless columns name one; the check of several tickers or timeframes in one batch is
    in `mixed_batches`.
    """
    w = Window.partitionBy(*(batch or SERIES)).orderBy("begin")
    same = Window.partitionBy(*(batch or SERIES), F.date_trunc("second", F.col("begin")))
    found = [
        (F.col("begin").isNull(), "no begin"),
        (F.least(*PRICES) <= 0, "price not positive"),
        (F.col("high") < F.col("low"), "high below low"),
        (F.col("volume") <= 0, "volume not positive"),
        (F.count("*").over(same) > 1, "duplicate begin"),
        (F.lag("end").over(w) > F.col("begin"), "overlaps the candle before"),
    ]
    return df.withColumn("violations", F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in found]), lambda x: x.isNotNull()))


def gated(df: DataFrame, batch: tuple[str, ...], row: str = "row") -> DataFrame:
    """df with rejected_row and rejected_rule, the first violation of a row's batch; both are null where the batch is fit.

    Rows are looked at in the order of the column row, each for all of its own faults; if there is none, in order of begin, each
    against the batch's first candle and the one before. row counts from 0 within a batch; in the second look the place by begin
    is told. A missing price or volume counts as 0. A batch, which is what one request stores, is put in order within one task.
    """
    w = Window.partitionBy(*batch).orderBy("begin", row)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    own = [
        (F.col("begin").isNull(), "no begin"),
        (F.least(*[zero(c) for c in PRICES]) <= 0, "price not positive"),
        (zero("high") < zero("low"), "high below low"),
        (zero("volume") <= 0, "volume not positive"),
    ]
    second = F.date_trunc("second", F.col("begin"))
    others = [
        (~F.first("ticker").over(w).eqNullSafe(F.col("ticker")), "several tickers"),
        (~F.first("timeframe").over(w).eqNullSafe(F.col("timeframe")), "several timeframes"),
        (F.lag(second).over(w) == second, "duplicate begin"),
        (F.lag("end").over(w) > F.col("begin"), "overlaps the candle before"),
    ]
    first_of = lambda rules: F.coalesce(*[F.when(c, F.lit(m)) for c, m in rules])
    looks = df.withColumns({"_own": first_of(own), "_other": first_of(others), "_at": F.row_number().over(w).cast("long") - 1})
    fault = F.coalesce(F.when(F.col("_own").isNotNull(), F.struct(F.lit(1).alias("look"), F.col(row).cast("long").alias("at"), F.col("_own").alias("rule"))), F.when(F.col("_other").isNotNull(), F.struct(F.lit(2).alias("look"), F.col("_at").alias("at"), F.col("_other").alias("rule"))))
    found = looks.withColumn("_first", F.min(fault).over(Window.partitionBy(*batch)))
    return found.withColumns({"rejected_row": F.col("_first.at"), "rejected_rule": F.col("_first.rule")}).drop("_own", "_other", "_at", "_first")


def mixed_batches(df: DataFrame, batch: tuple[str, ...]) -> DataFrame:
    """Batches that hold more than one ticker or timeframe."""
    return df.groupBy(*batch).agg(F.countDistinct("ticker").alias("tickers"), F.countDistinct("timeframe").alias("timeframes")).where("tickers > 1 or timeframes > 1")


def batch_summary(df: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Count, first begin, end of the last row by begin, and source, of each stored series."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.min("begin").alias("first_begin"), F.max_by("end", "begin").alias("last_end"), F.min_by("source", "begin").alias("source"))


def wire_candles(df: DataFrame) -> DataFrame:
    """The eight fields that a model is sent."""
    return df.select("begin", *PRICES, "volume", "ticker", "timeframe")


def enough_rows(df: DataFrame, window: int, horizon: int, spare: int = 50) -> int:
    """The number of rows, or an error where it is too few to train on."""
    n = df.count()
    if n < window + horizon + spare:
        raise ValueError(f"{n} rows; {window + horizon + spare} are needed")
    return n
