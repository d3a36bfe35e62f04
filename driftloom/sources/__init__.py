"""Readers and writers: sequence files, annotation tables, scores and manifests."""
