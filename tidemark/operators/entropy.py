"""Entropies of groups and of histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators import windows as W


def group_entropy(share: Column, floor: float = 1e-10) -> Column:
    """An aggregate: -sum(p ln(p + floor))."""
    return -F.sum(share * F.log(share + floor))


def running_entropy(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str) -> DataFrame:
    """df with the entropy (base 2) of the values in the earlier rows of the key, `out`, and its share of the maximum, `out`_norm.

    A new row with a value that has come c times adds (c + 1) log2(c + 1) - c log2 c to the sum of c log2 c, so a running sum of these
    gives every row's entropy in linear time. Rows with a null value count as rows but have no share.
    """
    seen = F.row_number().over(W.ordered([*keys, value], order)) - 1
    xlog = lambda c: F.when(c > 0, c * F.log2(F.nullif(c, F.lit(0)).cast("double"))).otherwise(0.0)
    df = df.withColumn("_c", F.when(F.col(value).isNotNull(), seen)).withColumn("_d", xlog(F.col("_c") + 1) - xlog(F.col("_c")))
    df = W.running_distinct(df, keys, value, order, "_k")
    frame = W.before(keys, order)
    n, some, sums = F.count(F.lit(1)).over(frame), F.count("_c").over(frame), F.coalesce(F.sum("_d").over(frame), F.lit(0.0))
    df = df.withColumns({"_n": n, "_s": some, "_x": sums})
    n = F.nullif(F.col("_n"), F.lit(0)).cast("double")
    df = df.withColumn(out, (F.col("_s") * F.log2(n) - F.col("_x")) / n)
    norm = F.when(F.col("_k") > 1, F.col(out) / F.log2(F.col("_k").cast("double"))).when(F.col(out).isNotNull(), 0.0)
    return df.withColumn(f"{out}_norm", norm).withColumnRenamed("_k", f"{out}_kinds").drop("_c", "_d", "_n", "_s", "_x")
