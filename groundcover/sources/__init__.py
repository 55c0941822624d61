"""Readers and gated writers."""
