"""Evaluation: classes, signals, equity, and outcomes that come later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import class_sign
from ..session import SERIES
from .blocks import DEALT, ROWS, dealt, running
from .features import series


def confusion(df: DataFrame, keys: tuple[str, ...] = (), actual: str = "token", predicted: str = "prediction") -> DataFrame:
    """(keys, actual, predicted, n) over rows with a valid label."""
    return df.where(F.col(actual) != -1).groupBy(*keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_metrics(cells: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, and macro and weighted precision, recall and F1, from a confusion matrix. Classes are those that occur as a label
    or a prediction; a ratio of nothing is 0.
    """
    actual = cells.select(*keys, F.col("actual").alias("class"), F.col("n").alias("support"), F.lit(0).alias("said"), F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0).alias("hit"))
    said = cells.select(*keys, F.col("predicted").alias("class"), F.lit(0).alias("support"), F.col("n").alias("said"), F.lit(0).alias("hit"))
    by = actual.union(said).groupBy(*keys, "class").agg(F.sum("support").alias("support"), F.sum("said").alias("said"), F.sum("hit").alias("hit"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    by = by.withColumns({"precision": ratio(F.col("hit"), F.col("said")), "recall": ratio(F.col("hit"), F.col("support"))})
    by = by.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    weighted = lambda c: F.sum(F.col(c) * F.col("support")) / F.sum("support")
    out = [F.sum("support").alias("n"), (F.sum("hit") / F.sum("support")).alias("accuracy")]
    for c in ("f1", "precision", "recall"):
        out += [F.avg(c).alias(f"macro_{c}"), weighted(c).alias(f"weighted_{c}")]
    return by.groupBy(*keys).agg(*out)


def log_loss(df: DataFrame, keys: tuple[str, ...] = (), actual: str = "token", probabilities: str = "probabilities") -> DataFrame:
    """Mean of -ln of the probability that the label had, kept off 0 by the rounding of doubles."""
    p = F.element_at(probabilities, F.col(actual) + 1)
    return df.where(F.col(actual) != -1).groupBy(*keys).agg(F.avg(-F.log(F.greatest(p, F.lit(2.220446049250313e-16)))).alias("log_loss"))


def with_signals(df: DataFrame, n_classes: int, predicted: str = "prediction") -> DataFrame:
    return df.withColumn("signal", class_sign(predicted, n_classes))


def backtest_curve(df: DataFrame, capital: float = 100_000.0, commission: float = 0.0005, lag: int = 0, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """df (close, signal) with bar_return, strategy_return, equity, drawdown and traded.

    The signal of a bar earns the return into that bar; lag moves signals later by so many bars, for a test that does not look
    ahead. A change of the signal costs commission by its size.
    """
    df, many = dealt(df, keys, abs(lag) + 1, ROWS)
    w = series((*keys, "_block"))
    signal = F.lag("signal", lag, 0).over(w) if lag else F.col("signal")
    df = df.withColumn("_s", signal).withColumns({"bar_return": F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)), "traded": F.abs(F.col("_s") - F.lag("_s", 1, 0).over(w))})
    df = df.withColumn("strategy_return", F.col("_s") * F.col("bar_return") - F.col("traded") * commission).where("_own")
    df = running(df, keys, "product", 1 + F.col("strategy_return"), "equity", many).withColumn("equity", F.col("equity") * capital)
    df = running(df, keys, "max", F.col("equity"), "_peak", many)
    return df.withColumn("drawdown", F.try_divide(F.col("_peak") - F.col("equity"), F.col("_peak"))).drop("_s", "_peak", *DEALT)


def sharpe(x: str) -> Column:
    """Mean over population deviation; 0 where that is 0."""
    return F.coalesce(F.when(F.stddev_pop(x) > 0, F.avg(x) / F.stddev_pop(x)), F.lit(0.0))


def backtest_summary(curve: DataFrame, capital: float = 100_000.0, keys: tuple[str, ...] = SERIES) -> DataFrame:
    last = F.max_by("equity", "begin")
    hit = F.count_if(F.col("strategy_return") > 0)
    return curve.groupBy(*keys).agg(
        (last - capital).alias("total_pnl"), ((last - capital) / capital).alias("total_return"), sharpe("strategy_return").alias("sharpe_ratio"), F.max("drawdown").alias("max_drawdown"),
        F.count_if(F.col("traded") > 0).alias("n_trades"), (hit / F.count("*")).alias("win_rate"),
        F.coalesce(F.try_divide(hit, F.count_if(F.col("strategy_return") != 0)), F.lit(0.0)).alias("hit_rate"), last.alias("final_equity"),
    )


def trading_summary(df: DataFrame, n_classes: int, commission: float = 0.0005, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """What predicted tokens earn on forward returns (forward_return), which overlap for horizons over 1."""
    df, many = dealt(df.where("forward_return is not null"), keys, 1, ROWS)
    df = df.withColumns({"_p": class_sign("prediction", n_classes), "_t": class_sign("token", n_classes)})
    w = series((*keys, "_block"))
    df = df.withColumn("_d", F.abs(F.col("_p") - F.lag("_p", 1, 0).over(w))).withColumn("_r", F.col("_p") * F.col("forward_return") - F.col("_d") * commission)
    df = running(df.where("_own"), keys, "product", 1 + F.col("_r"), "_e", many)
    df = running(df, keys, "max", F.col("_e"), "_peak", many)
    df = df.withColumn("_dd", F.try_divide(F.col("_peak") - F.col("_e"), F.col("_peak")))
    active = F.col("_p") != 0
    share = lambda a, b: F.coalesce(F.try_divide(F.count_if(a), b), F.lit(0.0))
    return df.groupBy(*keys).agg(
        share(F.col("_p") == F.col("_t"), F.count("*")).alias("action_accuracy"), share(active & (F.signum("forward_return") == F.col("_p")), F.count_if(active)).alias("active_direction_hit_rate"),
        share(active, F.count("*")).alias("active_share"), (F.max_by("_e", "begin") - 1).alias("total_return"), sharpe("_r").alias("sharpe_per_trade"), F.max("_dd").alias("max_drawdown"), F.count_if(F.col("_d") > 0).alias("n_trades"),
    )


def simple_trading_metrics(df: DataFrame, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Buys where the prediction is above half the number of distinct predictions; drawdown of the running sum, in units of return."""
    kinds = df.groupBy(*keys).agg(F.countDistinct("prediction").alias("_k"))
    df, many = dealt(df.join(kinds, list(keys)), keys, 0, ROWS)
    df = df.where("_own").withColumn("_r", F.when(F.col("prediction") > F.floor(F.col("_k") / 2), F.col("forward_return")).otherwise(F.lit(0.0)))
    df = running(df, keys, "sum", F.col("_r"), "_c", many)
    df = running(df, keys, "max", F.col("_c"), "_peak", many).withColumn("_d", F.col("_peak") - F.col("_c"))
    return df.groupBy(*keys).agg(F.sum("_r").alias("total_pnl"), (F.count_if(F.col("_r") > 0) / F.count("*")).alias("win_rate"), sharpe("_r").alias("sharpe_ratio"), F.max("_d").alias("max_drawdown"))


def outcomes(predictions: DataFrame, candles: DataFrame, hours: int, keys: tuple[str, ...] = SERIES, strict: bool = False) -> DataFrame:
    """Predictions (keys, timestamp, prediction) whose candle `hours` later is there, with the return until then. Candles are
    unique by begin. The horizon counts hours whatever the timeframe. One whose own candle is missing is left out, or if strict an error.
    """
    then = predictions.withColumn("_due", F.col("timestamp") + F.make_dt_interval(hours=F.lit(hours)))
    now = candles.select(*keys, F.col("begin").alias("timestamp"), F.col("close").alias("_now"), F.lit(True).alias("_there"))
    later = candles.select(*keys, F.col("begin").alias("_due"), F.col("close").alias("_later"))
    joined = then.join(later, [*keys, "_due"]).join(now, [*keys, "timestamp"], "left" if strict else "inner")
    gain = F.try_divide(F.col("_later") - F.col("_now"), F.col("_now"))
    if strict:
        gain = F.when(F.col("_there"), gain).otherwise(F.raise_error(F.concat(F.lit("no candle at "), F.col("timestamp").cast("string"))))
    return joined.withColumn("actual_return", gain).drop("_due", "_now", "_later", "_there")


def online_report(found: DataFrame, above: int = 3, keys: tuple[str, ...] = SERIES) -> DataFrame:
    """Accuracy against up (1) or not (0), and what buying on predictions above a class earns."""
    up = F.when(F.col("actual_return") > 0, 1).otherwise(0)
    gain = F.when(F.col("prediction") > above, F.col("actual_return")).otherwise(F.lit(0.0))
    return found.groupBy(*keys).agg(
        F.count("*").alias("n_predictions"), (F.count_if(F.col("prediction") == up) / F.count("*")).alias("accuracy"), F.sum(gain).alias("total_pnl"),
        (F.count_if(gain > 0) / F.count("*")).alias("hit_rate"), F.count_if(gain > 0).alias("n_profitable_trades"),
    )


def leaderboard(results: DataFrame, n: int = 10) -> DataFrame:
    """The best results without an error, by validation macro-F1, then validation and test figures."""
    return results.where("error is null").orderBy(F.desc("val_macro_f1"), F.desc("val_action_accuracy"), F.desc("test_macro_f1")).limit(n)
