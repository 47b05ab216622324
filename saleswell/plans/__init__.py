"""Assembled marts and reports, and the registry of named queries."""
