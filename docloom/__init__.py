"""Docloom: a PySpark-native engine for document indexing and retrieval analytics."""

__version__ = "0.1.0"
