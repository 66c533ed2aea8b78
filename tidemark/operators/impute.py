"""Imputers that Spark's own doesn't have: the mean of the nearest rows, and the most frequent text, both as pipeline stages."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a fitted imputer keeps, at most; each task gets them, so this times the number of columns bounds what it holds.
DONORS = 20_000
#: Distances that are held at once, and donors that are measured again at once.
CELLS, AGAIN = 1 << 17, 1 << 16


def distances(rows: np.ndarray, donors: np.ndarray) -> np.ndarray:
    """Squared Euclidean distances over the coordinates that both have, scaled up to all of them; infinite where they share none."""
    a, b = ~np.isnan(rows), ~np.isnan(donors)
    x, y = np.where(a, rows, 0.0), np.where(b, donors, 0.0)
    if (a == a[:1]).all():  # rows with the same gaps share coordinates with the same donors
        a = a[:1]
    total = np.hstack([x * x, x]) @ np.hstack([b, -2 * y]).T
    total += a @ (y * y).T
    common = a.astype(float) @ b.T
    np.maximum(total, 0.0, out=total)
    total *= rows.shape[1] / np.maximum(common, 1)
    return total if (common > 0).all() else np.where(common > 0, total, np.inf)


def nearest(d: np.ndarray, k: int, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column), in order, of the finite ones about as small as the k-th of their row: no farther from a bound of it than the row's room.

    The k-th of the minima of groups of columns is no less than the k-th of all, and seldom much more.
    """
    width = max(1, d.shape[1] // (8 * k))
    groups = d.shape[1] // width
    bound = np.full(len(d), np.inf)
    if groups >= k:
        least = d[:, : groups * width].reshape(len(d), groups, width).min(2)
        bound = np.partition(least, k - 1, axis=1)[:, k - 1]
    at = np.flatnonzero(d <= (bound + room)[:, None])
    at = at[np.isfinite(d.ravel()[at])]
    return np.divmod(at, d.shape[1])


def filled(rows: np.ndarray, donors: np.ndarray, k: int, means: np.ndarray) -> np.ndarray:
    """rows with each missing value as the mean of the k nearest donors that have it (of equally near ones the first), or the column's mean if none is comparable.

    Products of matrices find the donors about as near as the k-th; those are measured again one by one, so rounding decides nothing.
    """
    out = rows.copy()
    gaps, shift = np.isnan(rows), np.nan_to_num(means)
    scale = np.nanmax(np.abs(donors - shift), initial=0.0) ** 2 * rows.shape[1]
    some = np.flatnonzero(gaps.any(1))
    some = some[np.lexsort(gaps[some].T)]
    step = max(1, CELLS // max(1, len(donors)))
    for at in range(0, len(some), step):
        block = some[at : at + step]
        near = distances(rows[block] - shift, donors - shift)
        room = 1e-9 * (scale + np.nanmax(np.abs(rows[block] - shift), axis=1, initial=0.0) ** 2 * rows.shape[1])
        for c in np.flatnonzero(gaps[block].any(0)):
            of = np.flatnonzero(gaps[block, c])
            able = np.flatnonzero(~np.isnan(donors[:, c]))
            r, j = nearest(near[np.ix_(of, able)] if len(able) < len(donors) or len(of) < len(block) else near, k, room[of])
            r, j = of[r], able[j]
            exact = np.empty(len(r))
            for n in range(0, len(r), AGAIN):
                off = (donors[j[n : n + AGAIN]] - rows[block[r[n : n + AGAIN]]]) ** 2
                exact[n : n + AGAIN] = np.nansum(off, 1) / (~np.isnan(off)).sum(1)
            order = np.lexsort((exact, r))  # stable: of equally near ones the first
            r, j = r[order], j[order]
            first = np.arange(len(r)) - np.searchsorted(r, r) < k
            r, value = r[first], donors[j[first], c]
            n = np.bincount(r, minlength=len(block))
            full = n == k
            out[block[full], c] = value[full[r]].reshape(-1, k).mean(1)
            for m in of[~full[of]]:  # where fewer donors are comparable
                out[block[m], c] = value[r == m].mean() if n[m] else means[c]
    return out


class NearestImputer(Estimator):
    """For each number a column `<name>_i` in which nulls and NaN are the mean of the k nearest rows that have the value.

    Nearness is Euclidean over the coordinates that both rows have, scaled up to all. The rows to be near to are learned: all that have a value,
    up to `donors`, else those with the least hashes of `drawn_by` (all columns but maps if not given). Ties go to the row with the lesser hash.
    A row that shares no coordinate with any donor gets the donors' mean; a column without any value stays null.
    """

    def __init__(self, numbers: Sequence[str], k: int = 5, donors: int = DONORS, drawn_by: Sequence[str] | None = None):
        super().__init__()
        self.numbers, self.k, self.donors, self.drawn_by = list(numbers), k, donors, drawn_by

    def _fit(self, df: DataFrame) -> NearestModel:
        by = list(self.drawn_by or [c for c, t in df.dtypes if not t.startswith("map")])
        known = [F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)) for c in self.numbers]
        some = df.select(F.xxhash64(*(f"`{c}`" for c in by)).alias("_h"), F.array(*known).alias("v")).where(F.exists("v", lambda x: x.isNotNull()))
        rows = some.orderBy("_h", "v").limit(self.donors).collect()  # at most `donors` rows
        kept = np.array([r.v for r in rows], float).reshape(-1, len(self.numbers))
        have = (~np.isnan(kept)).sum(0)
        means = np.where(have > 0, np.nansum(kept, 0) / np.maximum(have, 1), np.nan)
        return NearestModel(self.numbers, self.k, kept, means)


class NearestModel(Model):
    def __init__(self, numbers: list[str], k: int, donors: np.ndarray, means: np.ndarray):
        super().__init__()
        self.numbers, self.k, self.donors, self.means = numbers, k, donors, means

    def _transform(self, df: DataFrame) -> DataFrame:
        k = self.k
        held = df.sparkSession.sparkContext.broadcast((self.donors, self.means))  # DONORS rows at most

        def run(values: pd.DataFrame) -> pd.DataFrame:
            donors, means = held.value
            return pd.DataFrame(filled(values.to_numpy(float), donors, k, means), columns=values.columns)

        names = [f"n{n}" for n in range(len(self.numbers))]
        each = F.struct(*(F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(self.numbers, names, strict=True)))
        both = df.withColumn("_near", F.pandas_udf(run, ", ".join(f"{n} double" for n in names))(each))
        return both.withColumns({f"{c}_i": F.col("_near")[n] for c, n in zip(self.numbers, names, strict=True)}).drop("_near")


class FrequentImputer(Estimator):
    """For each text a column `<name>_f` in which nulls are the most frequent value, the least of equally frequent ones; `missing` where there is none."""

    def __init__(self, texts: Sequence[str], missing: str = "missing"):
        super().__init__()
        self.texts, self.missing = list(texts), missing

    def _fit(self, df: DataFrame) -> FrequentModel:
        each = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(f"`{c}`").cast("string").alias("v")) for n, c in enumerate(self.texts))))
        counts = df.select(each.alias("x")).select("x.*").where("v IS NOT NULL").groupBy("n", "v").agg(F.count("*").alias("times"))
        best = {r.n: r.v for r in counts.groupBy("n").agg(F.min_by("v", F.struct(-F.col("times"), "v")).alias("v")).collect()}  # a row for each column
        return FrequentModel({c: best.get(n, self.missing) for n, c in enumerate(self.texts)})


class FrequentModel(Model):
    def __init__(self, values: dict[str, str]):
        super().__init__()
        self.values = values

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({f"{c}_f": F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(v)) for c, v in self.values.items()})
