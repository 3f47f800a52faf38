"""Streaming ingest and the incremental scoring that follows it."""
