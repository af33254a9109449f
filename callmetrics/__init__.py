"""Spark-native analytics over large logs of scored model calls."""
