"""Structured Streaming: counters and job states."""
