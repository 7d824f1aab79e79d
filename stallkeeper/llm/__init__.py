"""Operators for training-data pipelines over tables of texts. Nothing outside this package imports it."""
