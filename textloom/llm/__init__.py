"""Operators of a training-data pipeline for language models.

Nothing else in ``textloom`` imports this subpackage.
"""
