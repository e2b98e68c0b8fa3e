"""Training-data operators: quality, deduplication, filtering, mixing, scoring and formatting of text tables."""
