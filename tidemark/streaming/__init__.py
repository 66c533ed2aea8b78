"""Structured Streaming forms of the role timeline and of resumable ingestion."""
