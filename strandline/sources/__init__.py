"""Strandline: sources."""
