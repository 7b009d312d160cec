"""Readers and writers of point-set files."""
