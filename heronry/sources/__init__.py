"""Stores and files that documents and token vectors are read from and written to."""
