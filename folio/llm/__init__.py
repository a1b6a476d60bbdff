"""Training-data operators: scoring, sanitising, duplicates, tokens, archives, packing."""
