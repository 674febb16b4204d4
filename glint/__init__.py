"""Exposure analytics over captured web assets and text corpora, on PySpark."""
