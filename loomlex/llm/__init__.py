"""Training-data operators: quality, deduplication, packing, filtering, extraction.

Nothing else in the library imports this subpackage.
"""
