"""Readers of labelled sequences and the sink of results."""
