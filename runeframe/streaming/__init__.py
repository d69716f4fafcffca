"""Structured Streaming forms of the archive's aggregations; an extension of the batch operators."""
