"""Nested columns taken apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _leaves(column: Column, kind: T.DataType, name: str) -> list[tuple[str, Column]]:
    if not isinstance(kind, T.StructType):
        return [(name, column)]
    return [leaf for f in kind for leaf in _leaves(column[f.name], f.dataType, f.name)]


def flattened(df: DataFrame) -> DataFrame:
    """df with every struct, at any depth, as the columns of its fields, in order; lists stay lists.

    A field keeps its own name; a name that is there already gets _1, _2 and so on.
    """
    leaves = [leaf for f in df.schema for leaf in _leaves(F.col(f"`{f.name}`"), f.dataType, f.name)]
    used: set[str] = set()
    out = []
    for name, column in leaves:
        free, k = name, 0
        while free.lower() in used:
            k += 1
            free = f"{name}_{k}"
        used.add(free.lower())
        out.append(column.alias(free))
    return df.select(*out)
