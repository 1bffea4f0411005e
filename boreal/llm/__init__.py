"""Training-data operators: search, deduplication, filtering, mixing and tokenising."""
