"""Training-data operators: deduplication, scoring, token counts, mixing, packing.

Nothing else in the library imports this subpackage; it can be removed as a
whole.
"""
