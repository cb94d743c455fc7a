"""sources of landloom."""
