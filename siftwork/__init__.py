"""siftwork: document search and corpus processing on Spark DataFrames."""

__version__ = "0.2.0"
