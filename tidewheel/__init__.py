"""Spark jobs that take a raw table from file to ranked models, and prepare training text."""
