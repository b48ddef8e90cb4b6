"""Structured Streaming jobs for quotes and news."""
