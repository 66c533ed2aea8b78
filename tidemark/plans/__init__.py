"""Feature groups, splits, evaluation and the queries built from the operators."""
