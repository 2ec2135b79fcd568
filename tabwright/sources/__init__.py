"""Readers and writers (S1–S15): format by extension, run log tables."""
