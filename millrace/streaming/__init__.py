"""Structured Streaming flows that reuse the batch operators."""
