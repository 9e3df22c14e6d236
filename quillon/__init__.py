"""Queries and data processing over collections of keyed documents, on Spark."""
