"""Readers and writers of point tables, boundaries and results."""
