"""Operators on training-data tables: documents, pages and embeddings.

Nothing outside this package imports it.
"""
