"""Column functions: text normalisation, hashing, similarity, blocking keys."""
