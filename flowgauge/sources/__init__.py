"""Readers and writers of flow tables."""
