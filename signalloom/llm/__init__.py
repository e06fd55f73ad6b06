"""Operators for preparing training data: texts, embeddings, web pages and conversations."""
