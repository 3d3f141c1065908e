"""Operators for preparing training text: scans, language, mixing, archives, search, scoring, tokens, quality, dedup."""
