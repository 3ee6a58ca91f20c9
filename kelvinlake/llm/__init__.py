"""Training-data operators: filters, near-duplicate search, scans, scoring, tokenizing and packing."""
