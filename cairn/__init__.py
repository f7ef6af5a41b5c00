"""Cairn: a PySpark engine for place-based heritage records."""
