"""Readers for landed files and the canonical views over the test tables."""
