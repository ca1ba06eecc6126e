"""Ingest and sinks."""
