"""Guarded analytics over star schemas and large text corpora, on Spark."""
