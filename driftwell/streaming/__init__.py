"""Structured Streaming forms of ingest, roll-up, baseline and reconciliation."""
