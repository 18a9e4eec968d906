"""Cantera: a Spark-native analytics engine for typed tables, points, texts and vectors."""

__version__ = "0.1.0"
