"""operators of landloom."""
