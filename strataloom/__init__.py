"""Strataloom: knowledge-base ETL, text analytics and retrieval as PySpark DataFrame transformations."""

__version__ = "0.1.0"
