"""Relational operators over catalog tables."""
