"""Strandline: streaming."""
