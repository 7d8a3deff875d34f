"""Part of tarnwick."""
