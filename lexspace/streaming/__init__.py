"""Incremental materialisation with Structured Streaming."""
