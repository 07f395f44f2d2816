"""Queries over the test tables, and SQL sessions."""
