"""Spark-native engine for class-labelled volumetric sample tables and training-data corpora."""
