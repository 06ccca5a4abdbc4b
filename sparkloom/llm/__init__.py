"""Training-data operators: deduplication, filtering, scoring and token output."""
