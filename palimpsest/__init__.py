"""Palimpsest: document-change analytics on Spark."""
