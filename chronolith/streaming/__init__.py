"""Streams: running conflict counts, and chunks that arrive in batches."""
