"""Feature tables for news articles, computed with Spark DataFrames."""

__version__ = "0.1.0"
