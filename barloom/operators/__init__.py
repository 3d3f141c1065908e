"""Operators on candle tables: cleaning, features, labels, windows, splits, models, evaluation, decisions."""
