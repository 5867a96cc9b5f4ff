"""Part of rasterloom."""
