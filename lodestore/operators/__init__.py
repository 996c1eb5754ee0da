"""Operators over object tables: lookup, index, delta and graph."""
