"""Decisions on requests: a model's signal, a rule-based signal, their weighted score, and risk limits.

A request row has probabilities, action and confidence of the model; last_close; rsi, macd_line, macd_signal, ema_20, ema_50,
volume_ratio, support_levels, resistance_levels; news (array of title, summary); and the portfolio's position, exposure, day_pnl
and limits. All is row by row, so any number of requests is one pass without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import clamp, direction_of, expected_position, first_five, keyword_class, known_action, nearest, unique


@dataclass(frozen=True)
class DecisionConfig:
    weight_algo: float = 0.6
    weight_llm: float = 0.4
    buy_threshold: float = 0.25
    sell_threshold: float = -0.25
    flags_block: bool = True
    base_size: float = 0.0
    max_position: float = 100.0
    max_exposure: float = 0.8
    max_daily_loss: float = 1000.0
    allow_short: bool = False
    horizon: str = "1H"
    provider: str = "heuristic-fallback"


#: Weights of the rules, by what they look at.
RSI_WEIGHT, MACD_WEIGHT, EMA_WEIGHT, LEVEL_WEIGHT, GOOD_NEWS, BAD_NEWS = 0.35, 0.25, 0.25, 0.15, 0.2, 0.25
#: What key factors say.
FACTORS = {
    "rsi_low": "RSI %.1f указывает на перепроданность", "rsi_high": "RSI %.1f указывает на перекупленность", "macd_up": "MACD выше сигнальной линии", "macd_down": "MACD ниже сигнальной линии",
    "ema_up": "EMA20 выше EMA50, краткосрочный тренд вверх", "ema_down": "EMA20 ниже EMA50, краткосрочный тренд вниз", "volume": "аномальный объём x%.2f", "support": "цена у ближайшей поддержки",
    "resistance": "цена у ближайшего сопротивления", "good_news": "новостной фон умеренно позитивный", "bad_news": "обнаружены негативные корпоративные новости",
}
NEWS = T.ArrayType(T.StructType([T.StructField("title", T.StringType()), T.StructField("summary", T.StringType())]))


def model_signal(cfg: DecisionConfig = DecisionConfig()) -> dict[str, Column]:
    """direction from the probabilities (from the action and its confidence where there are fewer than two), and the rest."""
    act = known_action("action")
    by_action = F.when(act == "BUY", F.col("confidence")).when(act == "SELL", -F.col("confidence")).otherwise(0.0)
    return {"algo_direction": F.coalesce(expected_position("probabilities"), by_action), "algo_action": act, "algo_confidence": clamp(F.col("confidence"), 0.0, 1.0)}


def _known(x: Column) -> Column:
    return F.filter(x, lambda y: y.isNotNull())


def heuristic_signal(df: DataFrame, cfg: DecisionConfig = DecisionConfig()) -> DataFrame:
    """df with llm_direction, llm_strength, llm_confidence, key_factors (five at most) and risk_flags."""
    rsi, close, zero = F.col("rsi"), F.col("last_close"), F.lit(0.0)
    low, high = (rsi > 0) & (rsi < 35), (rsi > 0) & (rsi > 65)
    macd = F.signum(F.col("macd_line") - F.col("macd_signal"))
    trend = F.signum(F.col("ema_20") - F.col("ema_50"))
    at_support = close <= nearest("support_levels", close, True) * 1.01
    at_resistance = close >= nearest("resistance_levels", close, False) * 0.99
    classes = F.coalesce(F.transform("news", lambda n: keyword_class(n["title"], n["summary"])), F.array().cast("array<int>"))
    df = df.withColumn("_news", classes)
    count = lambda k: F.size(F.filter("_news", lambda c: c == k))
    on = lambda c, x: F.when(c, F.lit(x)).otherwise(zero)
    # Weights are added one by one in this order: on a threshold, the rounding of doubles decides.
    with_news = lambda total, k, x: F.aggregate(F.filter("_news", lambda c: c == k), total, lambda a, _: a + F.lit(x))
    bullish = with_news(on(low, RSI_WEIGHT) + on(macd > 0, MACD_WEIGHT) + on(trend > 0, EMA_WEIGHT) + on(at_support, LEVEL_WEIGHT), 1, GOOD_NEWS)
    bearish = with_news(on(high, RSI_WEIGHT) + on(macd < 0, MACD_WEIGHT) + on(trend < 0, EMA_WEIGHT) + on(at_resistance, LEVEL_WEIGHT), -1, BAD_NEWS)
    says = lambda c, k, *x: F.when(c, F.format_string(FACTORS[k], *x) if x else F.lit(FACTORS[k]))
    spike = F.col("volume_ratio") >= 2.5
    factors = _known(F.array(says(low, "rsi_low", rsi), says(high, "rsi_high", rsi), says(macd > 0, "macd_up"), says(macd < 0, "macd_down"), says(trend > 0, "ema_up"), says(trend < 0, "ema_down"), says(spike, "volume", F.col("volume_ratio")), says(at_support, "support"), says(at_resistance, "resistance")))
    told = F.transform(F.filter("_news", lambda c: c != 0), lambda c: F.when(c > 0, F.lit(FACTORS["good_news"])).otherwise(F.lit(FACTORS["bad_news"])))
    flags = _known(F.array(F.when((rsi > 0) & ((rsi < 20) | (rsi > 80)), "extreme_rsi"), F.when(spike, "volume_spike"), F.when(count(-1) > 0, "negative_news"), F.when(F.col("exposure") >= 0.9, "high_portfolio_exposure")))
    df = df.withColumns({"_bull": bullish, "_bear": bearish, "key_factors": first_five(F.concat(factors, told)), "risk_flags": unique(flags)})
    diff = F.col("_bull") - F.col("_bear")
    df = df.withColumns({"llm_direction": F.when(diff > 0.15, "bullish").when(diff < -0.15, "bearish").otherwise("neutral"), "llm_strength": clamp(F.abs(diff), 0.0, 1.0)})
    confidence = clamp(0.2 + 0.3 * F.greatest("_bull", "_bear") + 0.3 * F.col("llm_strength"), 0.0, 1.0)
    confidence = F.when(F.col("llm_direction") == "neutral", F.least(confidence, F.lit(0.3))).otherwise(confidence)
    return df.withColumn("llm_confidence", confidence).withColumn("llm_provider", F.lit(cfg.provider)).drop("_news", "_bull", "_bear")


SIGNAL = ("llm_direction", "llm_strength", "llm_confidence", "key_factors", "risk_flags", "llm_provider")


def with_override(df: DataFrame) -> DataFrame:
    """The request's own signal in place of the rules' one, where `override` (a struct of direction, strength, confidence,
    key_factors, risk_flags) is not null.
    """
    own = {"llm_direction": "direction", "llm_strength": "strength", "llm_confidence": "confidence", "key_factors": "key_factors", "risk_flags": "risk_flags"}
    given = F.col("override").isNotNull()
    cols = {c: F.when(given, F.col(f"override.{k}")).otherwise(F.col(c)) for c, k in own.items()}
    return df.withColumns(cols | {"llm_provider": F.when(given, "request_override").otherwise(F.col("llm_provider"))})


def weighted_score(df: DataFrame, cfg: DecisionConfig = DecisionConfig()) -> DataFrame:
    """df with both components, score, action, decision_confidence and reason. A risk flag holds, but the score stays."""
    algo = F.lit(cfg.weight_algo) * F.col("algo_direction") * F.col("algo_confidence")
    llm = F.lit(cfg.weight_llm) * direction_of("llm_direction") * F.col("llm_strength") * F.col("llm_confidence")
    df = df.withColumns({"algo_component": algo, "llm_component": llm}).withColumn("score", F.col("algo_component") + F.col("llm_component"))
    flagged = F.lit(cfg.flags_block) & (F.coalesce(F.size("risk_flags"), F.lit(0)) > 0)
    buy, sell = F.col("score") >= cfg.buy_threshold, F.col("score") <= cfg.sell_threshold
    return df.withColumns(
        {
            "action": F.when(flagged, "HOLD").when(buy, "BUY").when(sell, "SELL").otherwise("HOLD"),
            "reason": F.when(flagged, "llm_risk_flag_override").when(buy, "score above buy threshold").when(sell, "score below sell threshold").otherwise("score inside hold band"),
            "decision_confidence": F.least(F.col("algo_confidence"), F.greatest(F.col("llm_confidence"), F.lit(0.2))),
        }
    )


def risk(df: DataFrame, cfg: DecisionConfig = DecisionConfig()) -> DataFrame:
    """df with approved, blocking_reasons, recommended_size and resulting_position. Limits of a request count if positive.

    A buy is capped by what the largest position leaves, covering a short included; a sell without short selling by the position;
    where short selling is off and there is nothing to sell, both that and the missing size are reasons.
    """
    own = lambda c, d: F.when(F.col(c) > 0, F.col(c)).otherwise(F.lit(d))
    position, act, zero = F.col("position"), F.col("action"), F.lit(0.0)
    most, exposure, loss = own("max_position", cfg.max_position), own("max_exposure", cfg.max_exposure), own("max_daily_loss", cfg.max_daily_loss)
    size = F.lit(cfg.base_size) if cfg.base_size > 0 else F.when(most > 0, most * F.col("decision_confidence")).otherwise(zero)
    size = F.greatest(zero, size)
    capped = F.when(most > 0, F.least(size, F.greatest(most - F.abs(position), zero))).otherwise(size)
    nothing = (act == "SELL") & (position <= 0) if not cfg.allow_short else F.lit(False)
    sold = capped if cfg.allow_short else F.least(size, position)
    df = df.withColumn("recommended_size", F.when(act == "HOLD", zero).when(act == "BUY", capped).when(nothing, zero).otherwise(sold))
    reasons = _known(
        F.array(
            F.when((loss > 0) & (F.col("day_pnl") <= -loss), "daily loss limit exceeded"),
            F.when((exposure > 0) & (F.abs("exposure") >= exposure), "portfolio exposure limit exceeded"),
            F.when(nothing, "short selling is disabled"),
            F.when(F.col("recommended_size") == 0, "no available position size after limits"),
        )
    )
    size = F.col("recommended_size")
    return df.withColumns(
        {
            "blocking_reasons": F.when(act == "HOLD", F.array().cast("array<string>")).otherwise(reasons),
            "resulting_position": F.when(act == "BUY", position + size).when(act == "SELL", position - size).otherwise(position),
        }
    ).withColumn("approved", F.size("blocking_reasons") == 0)


def evaluate_decisions(df: DataFrame, cfg: DecisionConfig = DecisionConfig()) -> DataFrame:
    """Requests with their whole decision. A model that failed (null confidence) holds; so does a trade that risk blocks, whose
    score stays. fallbacks say which happened.
    """
    failed = F.col("confidence").isNull()
    df = df.withColumns(model_signal(cfg)).withColumns({"algo_direction": F.when(failed, 0.0).otherwise(F.col("algo_direction")), "algo_confidence": F.when(failed, 0.0).otherwise(F.col("algo_confidence"))})
    df = heuristic_signal(df, cfg)
    df = risk(weighted_score(with_override(df) if "override" in df.columns else df, cfg), cfg)
    blocked = ~failed & ~F.col("approved") & (F.col("action") != "HOLD")
    neutral = lambda c, x: F.when(failed, F.lit(x)).otherwise(F.col(c))
    return df.withColumns(
        {
            "fallbacks": _known(F.array(F.when(failed, "ml_hold_fallback"), F.when(blocked, "risk_manager_hold"))),
            "reason": F.when(failed, "ml_unavailable_fallback").when(blocked, "risk_manager_block").otherwise(F.col("reason")),
            "action": F.when(failed | blocked, "HOLD").otherwise(F.col("action")),
            "score": neutral("score", 0.0), "algo_component": neutral("algo_component", 0.0), "llm_component": neutral("llm_component", 0.0),
            "llm_direction": neutral("llm_direction", "neutral"), "llm_strength": neutral("llm_strength", 0.0), "llm_confidence": neutral("llm_confidence", 0.2), "llm_provider": neutral("llm_provider", "skipped"),
            "approved": F.col("approved") & ~failed, "recommended_size": neutral("recommended_size", 0.0), "resulting_position": F.when(failed, F.col("position")).otherwise(F.col("resulting_position")),
        }
    )
