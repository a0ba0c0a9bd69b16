"""Operators of a training-data pipeline on documents, pages and embeddings."""
