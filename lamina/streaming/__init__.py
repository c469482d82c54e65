"""Incremental graph statistics."""
