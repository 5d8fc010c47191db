"""Queries over the test tables, one module per area."""
