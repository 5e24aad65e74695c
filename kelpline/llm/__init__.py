"""Training-data operators: near-dedup, mixing, PII, extraction, toxicity, search and output formats."""
