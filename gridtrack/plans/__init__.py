"""Whole queries: trackers, input checks, canonicalisation."""
