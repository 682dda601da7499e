"""Structured Streaming jobs over activity events and access logs."""
