"""Readers and writers for scene file formats."""
