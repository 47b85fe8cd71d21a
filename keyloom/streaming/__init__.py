"""Conversion of a growing folder in micro-batches."""
