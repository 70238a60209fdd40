"""Structured Streaming versions of the scoring and mosaic operators."""
