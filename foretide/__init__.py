"""Spark-native analytics over timed sessions: clocks, windows, forecasts, audits."""
