"""Readers and writers: chat records, packed samples, manifests, tables."""
