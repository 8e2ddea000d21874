"""Streaming use of the batch plans."""
