"""Structured Streaming operators over the event log."""
