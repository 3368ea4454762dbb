"""Operators for preparing training text: search, scoring, extraction, duplicates, redaction, mixing, packing."""
