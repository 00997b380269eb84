"""Scalar functions as Column expressions, and the packed kernel."""
