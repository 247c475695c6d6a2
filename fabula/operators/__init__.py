"""Relational operators over elements, passages, lines and chunks."""
