"""Training-data operators: filtering, tokenising, deduplication, mixing, formatting."""
