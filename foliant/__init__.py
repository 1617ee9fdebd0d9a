"""Foliant: document-corpus analytics as PySpark DataFrame pipelines."""
