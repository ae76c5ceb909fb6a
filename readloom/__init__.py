"""Spark-native analytics over DNA sequencing reads."""
