"""Operators for preparing training text and embeddings at scale."""
