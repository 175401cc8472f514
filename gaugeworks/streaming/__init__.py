"""Structured Streaming forms of the live and export feeds."""
