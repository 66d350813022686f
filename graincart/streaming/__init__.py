"""Structured Streaming counterparts (an extension)."""
