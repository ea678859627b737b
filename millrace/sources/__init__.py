"""Readers, writers and column profiling."""
