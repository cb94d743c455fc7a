"""functions of landloom."""
