"""Operators on tables of sequences, counts and predictions."""
