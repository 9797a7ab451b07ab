"""Operators on conversations, samples and run metrics."""
