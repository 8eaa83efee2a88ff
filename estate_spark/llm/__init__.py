"""Operators of a training-data pipeline, one module each; nothing outside imports this package."""
