"""Operators for building training data: text, tokens, vectors and mixtures as Spark jobs."""
