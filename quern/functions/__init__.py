"""Column functions: text, scoring, vectors, probabilities."""
