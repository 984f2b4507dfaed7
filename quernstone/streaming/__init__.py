"""Structured Streaming: continuous ingest and live task counts."""
