"""Incremental arrival of books."""
