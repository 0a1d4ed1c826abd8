"""Operators of a training-data pipeline: each takes and gives DataFrames over a table of documents or pages."""
