"""Training-data operators: scoring, packing, formatting, deduplication, mixing, privacy, media, fingerprints, language."""
