"""Training-data operators: scoring, filtering, deduplication, sanitising, mixing, tokenising and search.

Nothing else in the library imports this package.  Module ``registry`` lists its queries.
"""
