"""Granary: a PySpark-native engine for document analytics and retrieval."""

__version__ = "0.1.0"
