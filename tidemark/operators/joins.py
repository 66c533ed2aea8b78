"""Joins that Spark has no operator for."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_joins(left: DataFrame, keys: Sequence[str], left_time: str, sides: Sequence[tuple[DataFrame, str, Sequence[str], Sequence[str]]], piece: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with the payload of each side's last row with the same keys and a time that isn't later, null where there is none.

    sides: (rows, time, payload, ties); of rows at the same time the last by `ties` counts. All go through one shuffle as one sequence,
    by the keys and the piece of time that a row is in: its day, or what `piece` makes of a time (it must never fall as time goes on; needed
    where times are neither dates nor timestamps, which else are one piece). Each piece's last payloads are carried to later ones in a
    window with one row for each key and piece, so no task gets more than a piece of a key, however many rows the key has.
    """
    most = max(len(s[3]) for s in sides)
    dated = left.schema[left_time].dataType.typeName() in ("date", "timestamp", "timestamp_ntz")
    cut = piece or (F.to_date if dated else lambda _: F.lit(0))
    none = lambda names: [F.lit(None).alias(n) for n in names]
    slots = [f"_right{k}" for k in range(len(sides))]
    rows = left.select(*keys, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"), *none(slots), *none(f"_t{k}" for k in range(most)))
    for n, (right, time, payload, ties) in enumerate(sides):
        tie = [F.col(c).alias(f"_t{k}") for k, c in enumerate(ties)] + none(f"_t{k}" for k in range(len(ties), most))
        mine = [F.struct(*payload).alias(s) if s == slots[n] else F.lit(None).alias(s) for s in slots]
        rows = right.select(*keys, F.col(time).alias("_time"), F.lit(0).alias("_side"), F.lit(None).alias("_left"), *mine, *tie).unionByName(rows)
    rows = rows.withColumn("_piece", cut(F.col("_time")))
    order = ["_time", "_side", *(f"_t{k}" for k in range(most))]
    frame = Window.partitionBy(*keys, "_piece").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumns({s: F.last(s, ignorenulls=True).over(frame) for s in slots}).where("_side = 1")
    last = [F.max_by(s, F.when(F.col(s).isNotNull(), F.struct(*order))).alias(s) for s in slots]
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*keys, "_piece").agg(*last).withColumns({s: F.last(s, ignorenulls=True).over(earlier) for s in slots})
    carried = carried.select(*(F.col(k).alias(f"_k{n}") for n, k in enumerate([*keys, "_piece"])), *(F.col(s).alias(f"_before{s}") for s in slots))
    same = [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate([*keys, "_piece"])]
    found = found.join(carried, reduce(lambda a, b: a & b, same)).withColumns({s: F.coalesce(s, f"_before{s}") for s in slots})
    return found.select("_left.*", *(F.col(f"{s}.{c}").alias(c) for s, (_, _, payload, _) in zip(slots, sides, strict=True) for c in payload), *(F.col(s).isNotNull().alias(f"_found{n}") for n, s in enumerate(slots)))


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, payload: Sequence[str], ties: Sequence[str], inner: bool = True, piece: Callable[[Column], Column] | None = None) -> DataFrame:
    """asof_joins() with one side. Rows of left without a match stay if `inner` is off."""
    found = asof_joins(left, keys, left_time, [(right, right_time, payload, ties)], piece)
    return (found.where("_found0") if inner else found).drop("_found0")


def dense(df: DataFrame, keys: Sequence[str], slot: str, first: int, last: int, values: Sequence[str]) -> DataFrame:
    """A row for each key and each slot from first to last; missing values are 0. Slots are made inside each row, so no rows are crossed."""
    slots = df.select(*keys).distinct().withColumn(slot, F.explode(F.sequence(F.lit(first), F.lit(last))))
    return slots.join(df, [*keys, slot], "left").fillna(0, list(values))


def first_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """The columns of the least row of each key by a total order; combined before the shuffle, without a sort."""
    least = F.min_by(F.struct(*columns), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(least).select(*keys, "_row.*")


def lookup_by_rank(df: DataFrame, names: DataFrame, ranks: dict[str, str], rank: str, name: str, id: str) -> DataFrame:
    """df with the id of each named ancestor: for each rank a column of names that is looked up among the rows of that rank."""
    for value, column in ranks.items():
        one = names.where(F.col(rank) == value).select(F.col(name).alias(column), F.col(id).alias(f"{column}_{id}"))
        df = df.join(one, column, "left")
    return df
