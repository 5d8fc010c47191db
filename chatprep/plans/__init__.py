"""End-to-end plans and the catalog of checked queries."""
