"""Training-data operators: deduplication, fingerprints, tokenizing, extraction, scans and classifiers."""
