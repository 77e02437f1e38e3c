"""Weft: a PySpark-native engine for sequence, text and instruction-data analytics."""
