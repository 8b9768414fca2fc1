"""Operators: DataFrame functions for aligning, segmenting, summarising and clustering signals."""
