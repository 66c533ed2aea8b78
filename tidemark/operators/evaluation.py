"""Temporal splits and folds; metrics of rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import windows as W
from tidemark.operators.shrink import ratio

#: Buckets of a score from 0 to 1 that meet in one window.
STEPS = 10_000
#: Rows of one score that are ranked by one task at most.
TIED = 100_000


def temporal_split(df: DataFrame, time: str, id: str, cutoff: str, val: tuple[str, str], test: str, most_val: int | None = None, most_test: int | None = None) -> DataFrame:
    """(id, split): train before the cutoff, val in [from, to), test from its start on; rows in the gaps are left out.

    val and test keep their earliest rows by time, then by the digest of the id. Places come from counts for each day, so no task sorts a split.
    """
    t = F.col(time)
    at = lambda x: F.lit(x).cast("timestamp_ntz")
    split = F.when(t < at(cutoff), "train").when((t >= at(val[0])) & (t < at(val[1])), "val").when(t >= at(test), "test")
    rows = df.select(id, time).withColumn("split", split).where("split IS NOT NULL")
    if most_val is None and most_test is None:
        return rows.select(id, "split")
    placed = W.with_offsets(rows.withColumn("_one", F.lit(1)), F.to_date(time), ["_one"], keys=["split"])
    place = F.col("_o__one") + F.row_number().over(Window.partitionBy("split", "_b").orderBy(time, F.md5(F.col(id).cast("string"))))
    most = F.when(F.col("split") == "val", F.lit(most_val)).when(F.col("split") == "test", F.lit(most_test))
    return placed.withColumn("_place", place).where(most.isNull() | (F.col("_place") <= most)).select(id, "split")


def expanding_folds(df: DataFrame, time: str, id: str, folds: int, gap_days: int) -> DataFrame:
    """(fold, id, role): fold k validates on the k-th of folds + 1 chunks in order of time and trains on those before it, but for a gap.

    Chunk sizes differ by one at most. Places come from counts for each day, so no task sorts all rows.
    """
    placed = W.with_offsets(df.select(id, time, F.lit(1).alias("_one")), F.to_date(time), ["_one"])
    placed = placed.withColumn("_k", F.col("_o__one") + F.row_number().over(Window.partitionBy("_b").orderBy(time, id)) - 1)
    total = df.count()
    small, large = total // (folds + 1), total % (folds + 1)
    edge = large * (small + 1)
    chunk = F.when(F.col("_k") < edge, F.floor(F.col("_k") / (small + 1))).otherwise(large + F.floor((F.col("_k") - edge) / max(small, 1)))
    placed = placed.select(id, time, chunk.cast("int").alias("chunk"))
    starts = placed.groupBy("chunk").agg(F.min(time).alias("start"))  # as many rows as there are chunks
    fold = F.explode(F.sequence(F.greatest(F.col("chunk"), F.lit(1)), F.lit(folds))).alias("fold")
    each = placed.select(id, time, "chunk", fold).join(F.broadcast(starts.withColumnRenamed("chunk", "fold")), "fold")
    role = F.when(F.col("chunk") == F.col("fold"), "val").when(F.col(time) < F.col("start") - F.make_dt_interval(F.lit(gap_days)), "train")
    return each.select("fold", id, role.alias("role")).where("role IS NOT NULL")


def step_of(score: str) -> Column:
    """A bucket for scores that lie between 0 and 1."""
    return F.floor(F.col(score) * STEPS)


def ranked(df: DataFrame, score: str, label: str, id: str) -> DataFrame:
    """df with `place`, `hits` (positives so far) by descending score, then id; null scores last.

    Rows are ranked within steps of the score, whose sums are carried on. A score that more rows share than TIED (or than an even
    step has, if that is more) gets buckets of its own, cut by ranges of the id where that is a number, so ties of any size
    are many tasks; there are at most STEPS such scores.
    """
    limit = max(TIED, df.count() // STEPS)
    number = df.schema[id].dataType.typeName() in ("long", "integer", "short", "byte")
    tied = df.groupBy(score).agg(F.count("*").alias("n"), *((F.min(id).alias("low"), F.max(id).alias("high")) if number else (F.lit(0).alias("low"), F.lit(0).alias("high")))).where(F.col("n") > limit)
    tied = tied.select(step_of(score).alias("_step"), F.struct(F.col(score).alias("score"), "n", "low", "high").alias("x")).groupBy("_step").agg(F.collect_list("x").alias("_tied"))
    rows = df.withColumn("_one", F.lit(1)).withColumn("_s", step_of(score)).join(F.broadcast(tied), F.col("_s") == F.col("_step"), "left")  # a row for each step that has such scores
    own = F.get(F.filter("_tied", lambda x: x["score"] == F.col(score)), F.lit(0))
    above = F.coalesce(F.size(F.filter("_tied", lambda x: x["score"] > F.col(score))), F.lit(0))
    width = F.greatest((own["high"] - own["low"] + 1) / F.ceil(own["n"] / limit), F.lit(1.0))
    part = F.coalesce(F.floor((F.col(id) - own["low"]) / width), F.lit(0)) if number else F.lit(0)
    bucket = F.struct(F.col(score).isNull().alias("last"), (-F.col("_s")).alias("step"), above.alias("above"), own.isNotNull().alias("tied"), part.alias("part"))
    rows = W.with_offsets(rows.withColumn("_bucket", bucket).drop("_s", "_step", "_tied"), F.col("_bucket"), ["_one", label])
    inner = Window.partitionBy("_b").orderBy(F.desc(score), id)
    rows = rows.withColumn("place", F.col("_o__one") + F.row_number().over(inner)).withColumn("hits", F.col(f"_o_{label}") + F.sum(label).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.drop("_b", "_bucket", "_one", "_o__one", f"_o_{label}")


def curve_at(df: DataFrame, shares: Sequence[float], score: str, label: str, id: str) -> DataFrame:
    """(k_pct, n_reviewed, recall, precision, lift) of the first ceil(share * n) rows, for each share."""
    n, positives = df.agg(F.count("*"), F.sum(label)).first()
    rows = ranked(df, score, label, id)
    wanted = df.sparkSession.createDataFrame([(s * 100, min(n, -int(-s * n // 1))) for s in shares], "k_pct double, place long")
    found = rows.join(F.broadcast(wanted), "place")  # one row for each share
    return found.select("k_pct", F.col("place").alias("n_reviewed"), (F.col("hits") / positives).alias("recall"), (F.col("hits") / F.col("place")).alias("precision"), (F.col("hits") / F.col("place") / (positives / n)).alias("lift"))


def thresholds(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, n, h, all, hits): for each distinct score its rows and positives, and those of it and all higher scores."""
    by = df.groupBy(score).agg(F.count("*").alias("n"), F.sum(label).alias("h"))
    by = W.with_offsets(by, step_of(score), ["n", "h"], descending=True)
    w = Window.partitionBy("_b").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    return by.select(F.col(score).alias("score"), "n", "h", (F.col("_o_n") + F.sum("n").over(w)).alias("all"), (F.col("_o_h") + F.sum("h").over(w)).alias("hits"))


def average_precision(df: DataFrame, score: str, label: str) -> DataFrame:
    """(average_precision): the sum over distinct scores of the gain in recall times the precision there."""
    return thresholds(df, score, label).agg((F.sum(F.col("h") * F.col("hits") / F.col("all")) / F.sum("h")).alias("average_precision"))


def roc_auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """(roc_auc): the share of pairs of a positive and a negative row in which the positive scores higher; ties count half."""
    higher = F.col("all") - F.col("hits") - (F.col("n") - F.col("h"))  # negatives above
    lost = F.sum(F.col("h") * (higher + 0.5 * (F.col("n") - F.col("h"))))
    positives, negatives = F.sum("h"), F.sum(F.col("n") - F.col("h"))
    return thresholds(df, score, label).agg((1 - lost / F.nullif((positives * negatives).cast("double"), F.lit(0.0))).alias("roc_auc"))


def report(df: DataFrame, score: str, label: str, threshold: float) -> DataFrame:
    """(class, precision, recall, f1, support, accuracy) of both classes, rows at the threshold or above being predicted positive."""
    said, true = F.col(score) >= threshold, F.col(label) > 0
    g = df.agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & ~true).alias("tn"), F.count_if(~said & true).alias("fn"))
    side = lambda c, hit, wrong, missed: F.struct(F.lit(c).alias("class"), F.col(hit).alias("hit"), F.col(wrong).alias("wrong"), F.col(missed).alias("missed"))
    g = g.select(F.explode(F.array(side(0, "tn", "fn", "fp"), side(1, "tp", "fp", "fn"))).alias("s"), ratio(F.col("tp") + F.col("tn"), F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("accuracy"))
    hit, wrong, missed = (F.col(f"s.{c}") for c in ("hit", "wrong", "missed"))
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    return g.select(F.col("s.class").alias("class"), zero(ratio(hit, hit + wrong)).alias("precision"), zero(ratio(hit, hit + missed)).alias("recall"), zero(ratio(2 * hit, 2 * hit + wrong + missed)).alias("f1"), (hit + missed).alias("support"), "accuracy")


def recall_area(df: DataFrame, score: str, label: str, id: str) -> DataFrame:
    """(recall_area): the area under recall over the share of rows reviewed, by trapezoids between rows."""
    n = F.count("*")
    g = ranked(df, score, label, id).agg(F.sum("hits").alias("s"), F.max("hits").alias("p"), F.min_by("hits", "place").alias("first"), n.alias("n"))
    return g.select((ratio(F.col("s") - (F.col("first") + F.col("p")) / 2, F.col("p") * F.col("n"))).alias("recall_area"))


def precision_at(df: DataFrame, share: float, score: str, label: str, id: str) -> DataFrame:
    """(n_reviewed, precision) of the first floor(share * n) rows; of none there is no precision."""
    rows = ranked(df, score, label, id)
    most = F.floor(F.lit(share) * df.count())
    g = rows.where(F.col("place") <= most).agg(F.count("*").alias("n_reviewed"), F.sum(label).alias("k"))
    return g.select("n_reviewed", ratio(F.col("k"), F.col("n_reviewed")).alias("precision"))


def operating_points(df: DataFrame, targets: Sequence[float], score: str, label: str) -> DataFrame:
    """(target, threshold, precision, recall): for each target the threshold whose precision is nearest, the lowest of equals."""
    by = thresholds(df, score, label)
    total = df.agg(F.sum(label).alias("positives"))  # one row
    by = by.crossJoin(F.broadcast(total)).select("score", ratio(F.col("hits"), F.col("all")).alias("precision"), ratio(F.col("hits"), F.col("positives")).alias("recall"))
    point = F.struct(F.col("score").alias("threshold"), "precision", "recall")
    best = by.agg(*(F.min_by(point, F.struct(F.round(F.abs(F.col("precision") - t), 12), "score")).alias(f"t{k}") for k, t in enumerate(targets)))
    each = F.array(*(F.struct(F.lit(float(t)).alias("target"), F.col(f"t{k}.threshold").alias("threshold"), F.col(f"t{k}.precision").alias("precision"), F.col(f"t{k}.recall").alias("recall")) for k, t in enumerate(targets)))
    return best.select(F.explode(each).alias("x")).select("x.*")


def calibration(df: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    """(bin, n, mean_score, positive_rate, brier) by equal ranges of the score."""
    at = F.least(F.floor(F.col(score) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return df.groupBy(at).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(label).alias("positive_rate"), F.avg(F.pow(F.col(score) - F.col(label), F.lit(2.0))).alias("brier"))
