"""Whole runs, and the catalogue of queries over the synthetic tables."""
