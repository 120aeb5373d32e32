"""Training-data operators: packing, scoring, deduplication, tokens and filters."""
