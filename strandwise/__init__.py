"""Spark-native pathogen genomics indices and data-preparation operators."""

__version__ = "0.1.0"
