"""Whole flows: alignment, self-canonicalisation, mapping, clustering."""
