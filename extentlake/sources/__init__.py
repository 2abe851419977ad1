"""Readers and writers of the pool formats."""
