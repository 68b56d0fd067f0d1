"""Commits as a stream."""
