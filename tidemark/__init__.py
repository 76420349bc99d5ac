"""tidemark: candle (OHLCV) analytics as plain Spark DataFrame transformations."""
