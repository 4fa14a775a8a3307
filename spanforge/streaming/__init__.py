"""Streams of interval files."""
