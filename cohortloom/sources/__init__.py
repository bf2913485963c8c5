"""Readers, writers and the layout of the input tables."""
