"""Operators of a training-data pipeline: pages, texts, conversations and embeddings."""
