"""Spark-native engine for job-posting corpora and the data around them."""
