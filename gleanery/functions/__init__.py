"""Column functions: text, vectors, dates and scores."""
