"""Expressions, aggregates and shares as Columns."""
