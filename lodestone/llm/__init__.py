"""Training-data operators: search, packing, deduplication, decontamination, tokens, archives and classifiers."""
