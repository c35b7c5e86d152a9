"""Training-data operators: decontamination, language models, sharding, near-duplicates and packing."""
