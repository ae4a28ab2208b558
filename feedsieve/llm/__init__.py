"""Training-data operators: mixing, near-duplicate joins, search, scoring, packing."""
