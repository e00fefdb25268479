"""Structured Streaming over the behaviour log."""
