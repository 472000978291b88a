"""Structured Streaming forms of the lake operators."""
