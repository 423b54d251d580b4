"""Spark-native analytics over file catalogs."""
