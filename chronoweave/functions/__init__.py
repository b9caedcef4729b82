"""Column functions: dates, text, vectors and row scores."""
