"""Spark-native analytics of gravity-field solutions."""
