"""Market-data analytics on Spark: every operator is a lazy DataFrame transformation."""

__version__ = "0.1.0"
