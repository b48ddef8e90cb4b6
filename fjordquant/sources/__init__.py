"""Readers and writers of the published tables."""
