"""Structured Streaming jobs over the same functions the batch queries use."""
