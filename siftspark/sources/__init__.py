"""Sources of the retrieval engine."""
