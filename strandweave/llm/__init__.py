"""Training-data operators: deduplication, packing, mixing, scoring, search and export."""
