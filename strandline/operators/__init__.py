"""Data operators."""
