"""Vectors and histograms as arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v.cast("double"))


def dot(x: Column, y: Column) -> Column:
    return total(F.zip_with(x, y, lambda a, b: a.cast("double") * b.cast("double")))


def cosine(x: Column, y: Column) -> Column:
    return dot(x, y) / F.nullif(F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)), F.lit(0.0))


def distance(x: Column, y: Column) -> Column:
    return F.sqrt(total(F.zip_with(x, y, lambda a, b: F.pow(a.cast("double") - b.cast("double"), F.lit(2.0)))))


def divergence(p: Column, q: Column, floor: float = 1e-10) -> Column:
    """The Kullback-Leibler divergence of p from q with a floor under both."""
    return total(F.zip_with(p, q, lambda a, b: (a + floor) * F.log((a + floor) / (b + floor))))


def blended(local: Column, prior: Column, weight: float) -> Column:
    """local + weight * prior / sum(prior), scaled to the sum 1; without a prior just local."""
    share = F.transform(prior, lambda v: v.cast("double") / F.nullif(total(prior), F.lit(0.0)))
    mixed = F.zip_with(local, share, lambda a, b: a.cast("double") + F.lit(float(weight)) * F.coalesce(b, F.lit(0.0)))
    return F.transform(mixed, lambda v: v / F.nullif(total(mixed), F.lit(0.0)))


def mean_place(p: Column) -> Column:
    """The mean of the places 1, 2, … under the weights p."""
    return total(F.transform(p, lambda v, k: v * (k + 1))) / F.nullif(total(p), F.lit(0.0))


def central_moment(p: Column, mean: Column, order: int) -> Column:
    return total(F.transform(p, lambda v, k: v * F.pow((k + 1).cast("double") - mean, F.lit(float(order))))) / F.nullif(total(p), F.lit(0.0))


def circular_lag(a: Column, b: Column, period: int) -> Column:
    """a - b folded to at most half a period on either side."""
    lag = F.pmod(a - b, F.lit(period))
    return F.when(lag > period // 2, lag - period).otherwise(lag)


def ordered_list(order: Column, value: Column) -> Column:
    """An aggregate: the values in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda s: s["v"])


def histogram(map: Column, first: int, last: int) -> Column:
    """The values of a map with integer keys as an array from the first to the last key, 0 where a key is missing."""
    return F.transform(F.sequence(F.lit(first), F.lit(last)), lambda k: F.coalesce(F.try_element_at(map, k), F.lit(0)))
