"""Readers and writers with strict schemas."""
