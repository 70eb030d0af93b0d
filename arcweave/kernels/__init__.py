"""Sequential algorithms on one group of rows, without Spark: run inside ``applyInPandas``."""
