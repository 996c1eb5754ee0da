"""Queries and reports."""
