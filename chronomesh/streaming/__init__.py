"""Structured Streaming variants of the sequential operators."""
