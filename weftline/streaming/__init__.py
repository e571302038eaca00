"""Structured Streaming forms of the stateful corpus operators."""
