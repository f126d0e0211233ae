"""Training-data operators: tokenising, packing, deduplication, classification, redaction.

Nothing else in the library imports this subpackage; it can be removed as a whole.
"""
