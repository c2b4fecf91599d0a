"""Structured Streaming: event ingestion, conversations with a shared registry, anchored rate limits."""
