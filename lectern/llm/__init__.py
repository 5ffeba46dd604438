"""Training-data operators: tokenising, filtering, deduplication, search and mixing.

Nothing outside this subpackage imports it.
"""
