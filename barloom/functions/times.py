"""Dates and intervals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Layouts of times in the order in which they are tried. The zoned ones come first.
ZONED = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]XXX", "yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX")
PLAIN = ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSSSSS][.SSSSSS][.SSS]", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm:ss[.SSSSSS]", "yyyy-MM-dd HH:mm", "yyyy-MM-dd")
#: Interval codes of candle sources by timeframe.
INTERVAL_CODES = {"1M": 1, "10M": 10, "1H": 60, "1D": 24}


def utc_clock(instant: Column) -> Column:
    """The UTC wall-clock time of an instant, whatever the session's zone: counted from 1970 on, so no hour is skipped or doubled."""
    seconds = (F.unix_micros(instant).cast("decimal(20,0)") / 1_000_000).cast("decimal(18,6)")
    return F.expr("timestamp_ntz'1970-01-01'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def flexible_time(text: str | Column) -> Column:
    """UTC wall-clock time of a text in any of the layouts; texts without a zone are UTC. Null where none fits."""
    t = F.trim(text)
    zoned = [F.try_to_timestamp(t, F.lit(p)) for p in ZONED]
    plain = [F.try_to_timestamp(F.concat(t, F.lit("Z")), F.lit(f"{p}XXX")) for p in PLAIN]
    return utc_clock(F.coalesce(*zoned, *plain))


def timeframe_interval(timeframe: str | Column) -> Column:
    """A day-time interval for <n>M (minutes), <n>H or <n>D; null for anything else and for zero."""
    t = F.upper(F.trim(timeframe))
    n, unit = F.regexp_extract(t, "^([0-9]{1,6})([MHD])$", 1), F.regexp_extract(t, "^([0-9]{1,6})([MHD])$", 2)
    n = F.when(n != "", n.cast("int"))
    zero = F.lit(0)
    made = F.make_dt_interval(F.when(unit == "D", n).otherwise(zero), F.when(unit == "H", n).otherwise(zero), F.when(unit == "M", n).otherwise(zero))
    return F.when(n > 0, made)


def interval_code(timeframe: str | Column) -> Column:
    """The source's code of a timeframe; null where it has none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in INTERVAL_CODES.items() for x in pair]), F.upper(F.trim(timeframe)))


def calendar(time: str | Column) -> dict[str, Column]:
    """hour, day_of_week (Monday is 0) and month."""
    return {"hour": F.hour(time), "day_of_week": F.weekday(time), "month": F.month(time)}


def batch_stamp(time: str | Column) -> Column:
    """A time as it stands in the names of stored batches."""
    return F.date_format(time, "yyyyMMdd'T'HHmm")
