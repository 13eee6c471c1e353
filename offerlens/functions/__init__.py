"""Column functions: text, dates, numbers, hashes, vectors."""
