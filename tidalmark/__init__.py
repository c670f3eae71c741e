"""Spark-native market-data feature and backtest engine."""
