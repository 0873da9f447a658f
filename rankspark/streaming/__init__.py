"""Structured Streaming jobs and user callbacks."""
