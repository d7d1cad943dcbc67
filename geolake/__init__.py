"""Columnar geometry tables for Spark: encodings, a quadtree index, spatial functions and table maintenance."""
