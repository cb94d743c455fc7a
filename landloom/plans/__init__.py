"""plans of landloom."""
