"""Importing this registers all queries."""

from tidemark.plans import features, graphs, history, labels, projections, relational, scalars, table_functions, training  # noqa: F401
