"""Structured Streaming versions of the counting operators."""
