"""Shapley values of boosted trees, exact and path-dependent: what each feature adds to a row's margin.

A tree is a sum of games, one for each leaf: with the features of a set known, the leaf's value counts if the row meets all its
conditions on them, times the share of training rows that met the conditions on the others. The Shapley value of such a
product is a polynomial in the number of known features, which numpy works out for all rows of a batch at once. Rows stay
where they are; the leaves, as many as the model has, go along with the function.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from math import factorial

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.util import MLWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: (value, features, their training shares, for each feature its conditions as (threshold or None, left categories, whether left is met))
Leaf = tuple[float, list[int], list[float], list[list[tuple]]]


def leaves(spark: SparkSession, model: MLWritable) -> list[Leaf]:
    """The leaves of a fitted model of one or several trees, values times the trees' weights; from what the model writes, in the folder that executors share."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{folder.rstrip('/')}/tidemark-trees-{uuid.uuid4().hex}"
    model.write().save(path)
    weights = dict(enumerate(getattr(model, "treeWeights", [1.0])))
    rows = spark.read.parquet(f"{path}/data")
    rows = rows.select("treeID", "nodeData.*") if "treeID" in rows.columns else rows.select(F.lit(0).alias("treeID"), "*")
    trees: dict[int, dict] = {}
    for r in rows.collect():  # the model, which the driver had before
        trees.setdefault(r.treeID, {})[r.id] = r
    return [leaf for k, nodes in sorted(trees.items()) for leaf in _of_tree(nodes, float(weights[k]))]


def _of_tree(nodes: dict, weight: float) -> list[Leaf]:
    found: list[Leaf] = []
    todo = [(0, {}, {})]
    while todo:
        at, shares, conditions = todo.pop()
        node = nodes[at]
        if node.leftChild < 0:
            names = list(shares)
            found.append((weight * node.prediction, names, [shares[f] for f in names], [conditions[f] for f in names]))
            continue
        f, split = node.split.featureIndex, node.split
        some = (split.leftCategoriesOrThreshold[0], None) if split.numCategories < 0 else (None, tuple(split.leftCategoriesOrThreshold))
        for child, left in ((node.leftChild, True), (node.rightChild, False)):
            share = nodes[child].rawCount / node.rawCount
            todo.append((child, {**shares, f: shares.get(f, 1.0) * share}, {**conditions, f: [*conditions.get(f, []), (*some, left)]}))
    return found


def expected(found: Sequence[Leaf]) -> float:
    """The margin of a row of which nothing is known."""
    return float(sum(v * np.prod(z) for v, _, z, _ in found))


def values(found: Sequence[Leaf], x: np.ndarray) -> np.ndarray:
    """The Shapley values of rows x features; with expected() a row's sum is its margin."""
    out = np.zeros(x.shape)
    for value, names, shares, conditions in found:
        m = len(names)
        met = [np.logical_and.reduce([(x[:, f] <= t if c is None else np.isin(x[:, f], c)) == left for t, c, left in each]).astype(float) for f, each in zip(names, conditions, strict=True)]
        for i, f in enumerate(names):
            known = [np.ones(len(x)), *(np.zeros(len(x)) for _ in range(m - 1))]  # by how many of the other features are known
            for n, j in enumerate(k for k in range(m) if k != i):
                for k in range(n + 1, -1, -1):
                    known[k] = known[k] * shares[j] + (known[k - 1] * met[j] if k else 0.0)
            weighed = sum(factorial(k) * factorial(m - 1 - k) / factorial(m) * known[k] for k in range(m))
            out[:, f] += value * (met[i] - shares[i]) * weighed
    return out


def attributed(found: Sequence[Leaf], features: Column) -> Column:
    """array<double> of each feature's Shapley value, from a vector column; null for a null vector."""

    def run(rows: pd.Series) -> pd.Series:
        known = rows.notna().to_numpy()
        out = pd.Series([None] * len(rows), dtype=object)
        if known.any():
            got = values(found, np.stack(rows[known].to_list()))
            for k, v in zip(np.flatnonzero(known), got, strict=True):
                out.iat[k] = v
        return out

    return F.pandas_udf(run, "array<double>")(F.when(features.isNotNull(), vector_to_array(features)))


def mean_absolute(df: DataFrame, column: str, names: Sequence[str]) -> DataFrame:
    """(feature, attribution, share): the mean absolute value of each named place of an array column, and its share of the sum of all."""
    each = df.select(F.posexplode(column).alias("k", "v")).groupBy("k").agg(F.avg(F.abs("v")).alias("attribution"))
    total = each.agg(F.sum("attribution").alias("total"))  # one row
    named = F.get(F.array(*map(F.lit, names)), F.col("k"))
    return each.crossJoin(F.broadcast(total)).select(named.alias("feature"), "attribution", (F.col("attribution") / F.nullif("total", F.lit(0.0))).alias("share"))
