"""Millrace: retrieval, document and evaluation analytics as PySpark DataFrame operators."""
