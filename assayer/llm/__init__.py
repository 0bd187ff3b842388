"""Training-data operators: cleaning, deduplication, fingerprints, archives, tokens."""
