"""Station time-series analytics expressed as Spark DataFrame operators."""
