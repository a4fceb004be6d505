"""Operators for training-data pipelines: one module per operator, all on Spark.

Each module documents its method and its result for nulls, empty and very long
texts, repeated rows, empty tables and extra columns. The operators read only
the columns they name, so further columns of the input cannot clash with theirs.
"""
