"""Xylem: an ordered-sequence query engine that runs as PySpark DataFrame plans."""

__version__ = "0.1.0"
