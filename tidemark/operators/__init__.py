"""Relational building blocks: windows, as-of joins, shrinkage, graphs, consensus."""
