"""Spark-native document ingestion: parse, lay out, check, chunk and enrich text collections as DataFrames."""

__version__ = "0.1.0"
