"""Continuous indexing of a folder with Structured Streaming."""
