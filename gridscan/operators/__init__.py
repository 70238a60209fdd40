"""Operators over pixel, tile, label and score tables."""
