"""Spark-native engine for effective-dated pricing data and the documents it comes from."""
