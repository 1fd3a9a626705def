"""Training-data operators: scoring, deduplication, decontamination, encoding and packing."""
