"""Incremental twins of batch operators on Structured Streaming."""
