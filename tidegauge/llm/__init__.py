"""Operators of a training-data pipeline, each on its own module."""
