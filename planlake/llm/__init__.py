"""Training-data operators: dedup, packing, mixing, toxicity, chat formatting, token counts, joins, PII."""
