"""indexloom: build and query a semantic index over files with Spark DataFrames."""

__version__ = "0.1.0"
