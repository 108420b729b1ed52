"""Operators of a training-data pipeline over documents, pages and embeddings.

Nothing outside this folder imports it; ``queries.py`` holds the registered queries.
"""
