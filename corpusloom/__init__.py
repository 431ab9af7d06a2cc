"""Corpusloom: a Spark-native engine for cleaning, chunking, indexing and searching text corpora."""

__version__ = "0.1.0"
