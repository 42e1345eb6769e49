"""Spark-native analytics over corpora of hand-motion captures and object tracks."""

__version__ = "0.1.0"
