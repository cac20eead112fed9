"""Column functions and small Arrow functions."""
