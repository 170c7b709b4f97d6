"""textloom: a PySpark-native library for curating text corpora and preference data."""

__version__ = "0.1.0"
