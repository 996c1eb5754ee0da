"""Streams of new objects."""
