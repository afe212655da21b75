"""Streams: the same operators over unbounded input."""
