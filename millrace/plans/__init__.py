"""Whole flows: analysis request, import batch, master scan."""
