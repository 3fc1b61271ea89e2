"""Training-data operators: deduplication, search, mixing, sharding, filters, tokenization.

Nothing outside this subpackage imports it.
"""
