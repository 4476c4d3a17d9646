"""lexmill: a PySpark-native engine for long-form text corpora and their usage ledgers."""

__version__ = "0.1.0"
