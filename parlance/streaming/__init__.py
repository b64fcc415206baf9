"""Structured Streaming forms of the live-session operators."""
