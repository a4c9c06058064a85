"""Training-data operators: quality rules, mixing, dedup, scoring, scans, tokenising, toxicity."""
