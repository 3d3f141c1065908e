"""Builders of columns: dates, texts, numbers, arrays and JSON. All are built-in expressions."""

from .arrays import argmax, expected_position, first_five, flat, nearest, padded_probabilities, top_probability, unique
from .numbers import class_action, class_sign, clamp, clipped_token, guarded_ratio, lenient_double, no_nan, nonzero
from .texts import as_json, contains_any, direction_of, error_message, first_text, known_action, keyword_class
from .times import batch_stamp, calendar, flexible_time, interval_code, timeframe_interval

__all__ = [
    "argmax", "as_json", "batch_stamp", "calendar", "clamp", "class_action", "class_sign", "clipped_token", "contains_any", "direction_of", "error_message", "expected_position",
    "first_five", "first_text", "flat", "flexible_time", "guarded_ratio", "interval_code", "keyword_class", "known_action", "lenient_double", "nearest", "no_nan", "nonzero",
    "padded_probabilities", "timeframe_interval", "top_probability", "unique",
]
