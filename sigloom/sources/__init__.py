"""Readers and writers for signals, metadata, score tables and stored representations."""
