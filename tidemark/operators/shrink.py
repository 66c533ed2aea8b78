"""Rates that are pulled towards a prior."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double, null where b is 0."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def shrunk(positives: Column, n: Column, prior: Column, weight: float) -> Column:
    """(weight * prior + positives) / (weight + n); without rows the prior."""
    return (F.lit(float(weight)) * prior + F.coalesce(positives, F.lit(0)).cast("double")) / (F.lit(float(weight)) + F.coalesce(n, F.lit(0)).cast("double"))


def prior_of(levels: Sequence[tuple[Column, Column, int]], default: Column) -> tuple[Column, Column]:
    """(prior, source): the rate of the first level that has its least number of rows, and that level's number from 1 on."""
    rate = F.coalesce(*(F.when(n >= least, ratio(k, n)) for k, n, least in levels), default)
    source = F.coalesce(*(F.when((n >= least) & ratio(k, n).isNotNull(), k_) for k_, (k, n, least) in enumerate(levels, 1)), F.lit(len(levels) + 1))
    return rate, source


def mean_of_others(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """df with the sum of the key's values without this row's, over the number of its other rows; null values count as rows.

    Sums are combined before they are shuffled and joined back, so a key may hold any share of the rows.
    """
    named = {k: f"_k{n}" for n, k in enumerate(keys)}
    sums = df.groupBy(*keys).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n")).select(*(F.col(k).alias(n) for k, n in named.items()), "_sum", "_n")
    same = reduce(lambda a, b: a & b, (df[k].eqNullSafe(sums[n]) for k, n in named.items()))
    return df.join(sums, same).withColumn(out, (F.col("_sum") - F.col(value)) / F.nullif(F.col("_n") - 1, F.lit(0)).cast("double")).drop("_sum", "_n", *named.values())
