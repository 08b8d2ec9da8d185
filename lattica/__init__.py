"""Labelled n-dimensional tensors as Spark DataFrames."""

__version__ = "0.1.0"
