"""Readers, page extraction, saved stages and report writers."""
