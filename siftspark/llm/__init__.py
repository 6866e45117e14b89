"""Training-data operators: each module holds one operator; ``registry`` turns them into queries."""
