"""Episode analytics on Spark: DataFrame-in, DataFrame-out operators for recorded manipulation episodes."""

__version__ = "0.1.0"
