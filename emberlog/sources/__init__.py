"""Readers and writers of lines and events."""
