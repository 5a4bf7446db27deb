"""Column functions: patterns, text normalisation, similarity, key classification."""
