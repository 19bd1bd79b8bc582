"""Training-data operators: deduplication, scoring, mixing, encoding and media columns over document tables."""
