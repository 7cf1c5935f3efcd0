"""Structured Streaming sources, sinks and the scoring flows."""
