"""Whole queries: records, scores, sinks, and the driver's queries."""
