"""Column functions: text, numbers as words, BIO sequences."""
