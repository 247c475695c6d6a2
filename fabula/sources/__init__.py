"""Readers and writers: books, configuration, caches, audio."""
