"""Operators of a training-data pipeline: quality, duplicates, languages, secrets, URLs, tokens."""
