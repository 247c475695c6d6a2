"""End-to-end plans and query definitions."""
