"""Training-data operators: quality, dedup, tokens, search, sharding, privacy."""
