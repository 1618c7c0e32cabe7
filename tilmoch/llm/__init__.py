"""Operators of a training-data pipeline: token counts, duplicates, leaks, packing, mixing, quality."""
