"""Spark-native analytics over product images: pixels, measures, rules, search and batches as DataFrames."""
