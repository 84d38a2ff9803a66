"""Spark jobs for a packaged-food nutrition catalog."""
