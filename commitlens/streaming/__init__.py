"""Structured Streaming counters and upsert."""
