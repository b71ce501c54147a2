"""Operators for building training corpora (one module each)."""
