"""Column functions: names, URLs, texts, vectors."""
