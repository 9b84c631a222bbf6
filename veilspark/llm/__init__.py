"""Operators for large-scale text corpora (language models' training data)."""
