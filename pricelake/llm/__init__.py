"""Operators of a training-data pipeline over text corpora; their queries are in ``queries``."""
