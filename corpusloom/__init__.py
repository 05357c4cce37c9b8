"""Chunked analysis of large text corpora as ordinary Spark DataFrame jobs."""

__version__ = "0.1.0"
