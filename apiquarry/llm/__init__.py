"""Operators for preparing training text: scans, dedup, classifiers, mixing, tokens, search."""
