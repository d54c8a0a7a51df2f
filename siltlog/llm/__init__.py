"""Training-data operators: filters, deduplication, tokenising, scoring and sharding of document tables."""
