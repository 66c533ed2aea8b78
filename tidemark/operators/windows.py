"""Histories of an entity: window frames that leave out the current row, running distinct counts, trailing days."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def ordered(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """Rows of a key in order; `order` should end with something unique. Nulls come last."""
    return Window.partitionBy(*keys).orderBy(*(F.col(c).asc_nulls_last() for c in order))


def before(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """All earlier rows of the key, without the current one."""
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def upto(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """All earlier rows of the key and the current one."""
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def peers(keys: Sequence[str], order: str) -> WindowSpec:
    """All rows of the key that aren't later, rows of the same time included."""
    return Window.partitionBy(*keys).orderBy(F.col(order).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)


def trailing_days(keys: Sequence[str], day: str, first: int, last: int) -> WindowSpec:
    """Rows of the key from `first` to `last` days before the current one's date."""
    return Window.partitionBy(*keys).orderBy(F.unix_date(day)).rangeBetween(-first, -last)


def whole(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys)


def is_first(keys: Sequence[str], order: Sequence[str]) -> Column:
    """1 for the first row of the key, else 0."""
    return (F.row_number().over(ordered(keys, order)) == 1).cast("int")


def running_distinct(df: DataFrame, keys: Sequence[str], value: str, order: Sequence[str], out: str, inclusive: bool = False) -> DataFrame:
    """df with the number of distinct values in the earlier rows of the key; nulls don't count.

    Marks each value's first row and sums the marks, which is linear where a window of sets isn't.
    """
    frame = upto(keys, order) if inclusive else before(keys, order)
    marked = df.withColumn("_new", F.when(F.col(value).isNotNull(), is_first([*keys, value], order)).otherwise(0))
    return marked.withColumn(out, F.coalesce(F.sum("_new").over(frame), F.lit(0))).drop("_new")


def with_offsets(df: DataFrame, bucket: Column, sums: Sequence[str], descending: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """df with `_b`, the row's bucket, and for each column of sums `_o_<column>`, its sum over all buckets of the key before that one.

    Only a row for each key and bucket meets in one window, so buckets should be few: days of a time, steps of a score. A
    sequence of a whole table, or of a key with a large share of it, is then a window within each bucket plus the bucket's offset.
    """
    df = df.withColumn("_b", bucket)
    totals = df.groupBy(*keys, "_b").agg(*(F.sum(c).alias(c) for c in sums))
    w = Window.partitionBy(*keys).orderBy(F.desc("_b") if descending else F.asc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    named = {k: f"_k{n}" for n, k in enumerate([*keys, "_b"])}
    totals = totals.select(*(F.col(k).alias(n) for k, n in named.items()), *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"_o_{c}") for c in sums))
    same = [df[k].eqNullSafe(totals[n]) for k, n in named.items()]
    return df.join(totals, reduce(lambda a, b: a & b, same)).drop(*named.values())


def running_totals(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], bucket: Column) -> DataFrame:
    """df with sums over all earlier rows of the key by `order`, for keys of which one may hold a large share of the table.

    bucket: a column that never falls as rows go on, like their day. No task gets more than the rows of a key and bucket.
    """
    named = {f"_v{k}": v for k, v in enumerate(values.values())}
    rows = with_offsets(df.withColumns(named), bucket, list(named), keys=keys)
    inner = Window.partitionBy(*keys, "_b").orderBy(*(F.col(c).asc_nulls_first() for c in order)).rowsBetween(Window.unboundedPreceding, -1)
    out = {o: F.col(f"_o_{n}") + F.coalesce(F.sum(n).over(inner), F.lit(0)) for o, n in zip(values, named, strict=True)}
    return rows.withColumns(out).drop("_b", *named, *(f"_o_{n}" for n in named))


def totals_asof(df: DataFrame, keys: Sequence[str], time: str, sums: Sequence[str], bucket: str, wanted: Column) -> DataFrame:
    """The rows of df that are `wanted`, with each column of sums as its sum over all rows of the key that aren't later; rows of the same time count together, null times have nothing before them.

    `bucket` is a number that never falls as time goes on. Rows are looked at by key and bucket; the last of each tells its sums, and these
    and the wanted rows meet by key. So df that is dealt out by key and bucket is read once and not shuffled again.
    """
    inner = Window.partitionBy(*keys, bucket).orderBy(F.col(time).asc_nulls_last())
    rows = df.withColumns({**{c: F.sum(c).over(inner.rangeBetween(Window.unboundedPreceding, Window.currentRow)) for c in sums}, "_last": F.lead(F.lit(1)).over(inner).isNull(), "_wanted": wanted})
    each = F.filter(F.array(F.when(F.col("_wanted"), F.lit(False)), F.when(F.col("_last") & F.col(bucket).isNotNull(), F.lit(True))), lambda x: x.isNotNull())
    rows = rows.where("_wanted OR _last").withColumn("_sum", F.explode(each)).drop("_last", "_wanted")
    rows = rows.withColumns({f"_o_{c}": F.when(F.col("_sum"), F.col(c)) for c in sums})
    before = Window.partitionBy(*keys).orderBy(F.col(bucket).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, -1)
    offset = lambda c: F.when(F.col(bucket).isNotNull(), F.coalesce(F.sum(f"_o_{c}").over(before), F.lit(0)))
    return rows.withColumns({c: F.col(c) + offset(c) for c in sums}).where("NOT _sum").drop("_sum", *(f"_o_{c}" for c in sums))


def running_total(df: DataFrame, time: str, id: str, values: dict[str, Column], bucket: Column | None = None) -> DataFrame:
    """running_totals() of the whole table by (time, id); the time itself is the bucket if none is given and it has few values."""
    return running_totals(df, [], [time, id], values, F.col(time) if bucket is None else bucket)


def percent_rank(df: DataFrame, keys: Sequence[str], value: str, step: Column, out: str) -> DataFrame:
    """df with the share of the key's other rows that have a smaller value; nulls come last, a row alone is at 0.

    step: a coarse value that never falls as the value rises, so that a key's rows are ranked step by step.
    """
    rows = with_offsets(df.withColumn("_one", F.lit(1)), F.coalesce(step.cast("long"), F.lit(2**63 - 1)), ["_one"], keys=keys)
    n = df.groupBy(*keys).agg(F.count("*").alias("_n")).select(*(F.col(k).alias(f"_g{j}") for j, k in enumerate(keys)), "_n")
    rows = rows.join(n, reduce(lambda a, b: a & b, (rows[k].eqNullSafe(n[f"_g{j}"]) for j, k in enumerate(keys))))
    smaller = F.col("_o__one") + F.rank().over(ordered([*keys, "_b"], [value])) - 1
    return rows.withColumn(out, F.when(F.col("_n") > 1, smaller / (F.col("_n") - 1)).otherwise(0.0)).drop("_one", "_b", "_o__one", "_n", *(f"_g{j}" for j in range(len(keys))))
