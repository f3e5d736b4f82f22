"""A session-memory graph engine on PySpark DataFrames."""

__version__ = "0.1.0"
