"""Registered queries, their SQL, and the benchmark runner."""
