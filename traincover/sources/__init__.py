"""Readers and the vector table."""
