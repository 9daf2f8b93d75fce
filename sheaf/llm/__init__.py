"""Training-data operators: deduplication, language ID, tokenising, packing, scoring, search.

Nothing else in the library imports this subpackage.
"""
