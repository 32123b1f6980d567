"""Operators for preparing training text: dedup, filters, tokens, shards."""
