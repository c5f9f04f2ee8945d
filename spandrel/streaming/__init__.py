"""Frames over Structured Streaming."""
