"""Structural analytics on Spark: code metrics, clones, vocabulary, graphs."""

__version__ = "0.1.0"
