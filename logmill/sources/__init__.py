"""Readers and fixed schemas."""
