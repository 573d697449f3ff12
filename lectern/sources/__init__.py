"""Readers, listings and row builders for sinks."""
