"""Lodestone: retrieval analytics and document processing as PySpark DataFrames."""

__version__ = "0.1.0"
