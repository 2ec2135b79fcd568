"""Streaming use of fitted transforms (extension: the reference has no streams)."""
