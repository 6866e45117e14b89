"""Functions of the retrieval engine."""
