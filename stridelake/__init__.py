"""stridelake: motion-series analytics expressed as Spark DataFrame operators."""
