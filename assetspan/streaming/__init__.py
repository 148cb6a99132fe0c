"""Incremental document tracking with Structured Streaming."""
