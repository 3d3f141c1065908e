"""Texts and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that make a news item positive or negative, tried in this order.
POSITIVE_NEWS = ("beat", "рост", "дивиденд", "прибыль", "buyback")
NEGATIVE_NEWS = ("санкц", "suspend", "halt", "убыт", "downgrade", "суд")


def known_action(x: str | Column) -> Column:
    """BUY, SELL or HOLD; anything else is HOLD."""
    t = F.upper(F.trim(x))
    return F.when(t.isin("BUY", "SELL"), t).otherwise("HOLD")


def direction_of(x: str | Column) -> Column:
    t = F.lower(F.trim(x))
    return F.when(t == "bullish", 1.0).when(t == "bearish", -1.0).otherwise(0.0)


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def keyword_class(title: Column, summary: Column) -> Column:
    """1 for a positive news item, -1 for a negative one, 0 for others; positive words are tried first."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit(""))))
    return F.when(contains_any(text, POSITIVE_NEWS), 1).when(contains_any(text, NEGATIVE_NEWS), -1).otherwise(0)


def error_message(body: str | Column) -> Column:
    """detail or error of a JSON body, else the body itself."""
    full = lambda path: F.nullif(F.get_json_object(body, path), F.lit(""))
    return F.coalesce(full("$.detail"), full("$.error"), F.trim(body))


def first_text(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in columns])


def as_json(*columns: str) -> Column:
    return F.to_json(F.struct(*columns))
