"""streaming of landloom."""
