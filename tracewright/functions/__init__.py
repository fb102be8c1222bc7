"""Column functions: text, arrays, scores."""
