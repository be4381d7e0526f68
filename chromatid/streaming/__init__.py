"""Incremental forms of the operators, as Structured Streaming."""
