"""Structured Streaming forms of the step loop."""
