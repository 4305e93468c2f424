"""Structured Streaming ingestion of raw transactions."""
