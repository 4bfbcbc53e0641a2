"""Structured Streaming: decoding, routing, deduplication, online features, current state."""
