"""Structured Streaming jobs over the observation log and arriving pages."""
