"""Training-data operators: scoring, near-duplicate removal, decontamination, mixing, sharding."""
