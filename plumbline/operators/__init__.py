"""Relational operators over scene tables."""
