"""Split planning and size statistics."""
