"""Operators of a training-data pipeline: mixing, labelling, deduplication, tokens, search."""
