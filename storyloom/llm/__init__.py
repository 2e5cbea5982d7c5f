"""Training-data operators: dedup, language id, fingerprints, packing, tokenising, extraction."""
