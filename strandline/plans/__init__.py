"""Strandline: plans."""
