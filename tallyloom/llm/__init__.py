"""Training-data operators: tokens, duplicates, language, quality, secrets, leaks, archives, URLs, packing."""
