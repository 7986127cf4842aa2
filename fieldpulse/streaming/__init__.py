"""Structured Streaming jobs: the analytics and storage consumers."""
