"""Checks on streams of texts."""
