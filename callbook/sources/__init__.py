"""Scans of landed files and stored tables."""
