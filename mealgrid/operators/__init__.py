"""Reusable relational operators over the catalog tables."""
