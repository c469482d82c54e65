"""Readers and writers of graphs."""
