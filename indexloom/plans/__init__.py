"""Whole jobs: building an index and asking it."""
