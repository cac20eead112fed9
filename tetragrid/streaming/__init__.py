"""Chunked sequences as streams."""
