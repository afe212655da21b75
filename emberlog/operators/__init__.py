"""Operators on DataFrames of log lines and events."""
