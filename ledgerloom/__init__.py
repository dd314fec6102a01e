"""Spark-native analytics over append-only ledger and event-log data."""
