"""Structured Streaming forms of binning and score ingestion."""
