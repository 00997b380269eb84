"""Relational operators on DataFrames of candidates, postings and token vectors."""
