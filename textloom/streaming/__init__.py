"""Streaming forms of operators that keep no order."""
