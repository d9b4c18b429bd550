"""Operators and queries of the training-data pipeline; nothing outside imports this package."""
