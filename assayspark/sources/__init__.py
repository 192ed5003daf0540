"""Readers, writers and stages."""
