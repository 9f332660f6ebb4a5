"""Scalar functions: rule formulas as columns, and conversions."""
