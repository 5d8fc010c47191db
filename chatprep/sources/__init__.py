"""Readers, writers and source normalisers."""
