"""Structured Streaming forms of the event merge and the leak scan."""
