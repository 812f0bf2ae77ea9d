"""Readers and writers of registry files and tables."""
