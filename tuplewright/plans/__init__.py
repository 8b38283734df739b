"""Plans that are more than one query: the schema language, the fixpoint, durable intermediate results."""
