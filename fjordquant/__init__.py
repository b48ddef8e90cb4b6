"""Equity-research analytics as set-based Spark jobs."""
