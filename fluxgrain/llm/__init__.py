"""Training-data operators: extraction, filtering, deduplication, scoring, packing.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
