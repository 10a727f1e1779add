"""Operators for large-scale text data; nothing outside this subpackage imports it."""
