"""Readers, ingestion rules and sinks."""
