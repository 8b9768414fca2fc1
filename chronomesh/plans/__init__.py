"""Queries built from the operators, with their DuckDB counterparts."""
