"""Spark-native analytics of market-style time series: bars, indicators, strategies and their evaluation."""
