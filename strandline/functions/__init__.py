"""Strandline: functions."""
