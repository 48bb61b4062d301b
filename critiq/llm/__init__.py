"""Training-data operators: scans, classifiers, near-duplicates, search, decontamination, mixing, token output."""
