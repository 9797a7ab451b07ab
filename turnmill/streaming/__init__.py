"""Streaming forms: metric logs as they grow, records packed once in micro-batches."""
