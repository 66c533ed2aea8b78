"""A classifier on the feature matrix with Spark's own pipeline: imputation, encoding, scaling, reduction, boosted trees, search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml import feature as mf
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import attribution, evaluation, impute as im, tuning
from tidemark.plans.registry import query, r
from tidemark.sources.tables import materialized

SCALERS: dict[str, Callable] = {
    "standard": lambda: mf.StandardScaler(inputCol="raw", outputCol="scaled", withMean=True),
    "minmax": lambda: mf.MinMaxScaler(inputCol="raw", outputCol="scaled"),
    "robust": lambda: mf.RobustScaler(inputCol="raw", outputCol="scaled"),
}
CLASSIFIERS: dict[str, Callable] = {
    "trees": lambda **kw: GBTClassifier(labelCol="y", featuresCol="features", seed=7, **{"maxIter": 10, "maxDepth": 4, **kw}),
    "logistic": lambda **kw: LogisticRegression(labelCol="y", featuresCol="features", **kw),
}

MOST_FREQUENT = "<most frequent>"


def columns(df: DataFrame, leave: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numbers and flags, texts) among the columns that aren't left out."""
    kinds = {c: t for c, t in df.dtypes if c not in leave}
    return [c for c, t in kinds.items() if t != "string"], [c for c, t in kinds.items() if t == "string"]


def pipeline(numbers: Sequence[str], texts: Sequence[str], impute: str | float = "median", missing: str = "missing", scale: str | None = None, components: int | None = None, classifier: str = "trees", **kw) -> Pipeline:
    """Imputes numbers and texts, encodes texts (unknown values get a slot of their own), scales and reduces if asked, classifies.

    impute: "mean", "median", "mode", "nearest" (the mean of the five nearest rows) or a constant. Missing texts are a value of their own, `missing`, or with
    missing=MOST_FREQUENT the most frequent one. Further arguments are the classifier's: `validationIndicatorCol` stops boosting when those rows get
    no better, `weightCol` weighs rows (see `class_weights`).
    """
    if impute == "nearest":
        stages: list = [im.NearestImputer(numbers)]
    elif isinstance(impute, str):
        stages = [mf.Imputer(strategy=impute, inputCols=list(numbers), outputCols=[f"{c}_i" for c in numbers])]
    else:
        filled = ", ".join(f"coalesce(nullif(`{c}`, double('NaN')), double({impute!r})) AS `{c}_i`" for c in numbers)
        stages = [mf.SQLTransformer(statement=f"SELECT *, {filled} FROM __THIS__")]
    if texts:
        known = ", ".join(f"coalesce(`{c}`, '{missing}') AS `{c}_f`" for c in texts)
        stages.append(im.FrequentImputer(texts) if missing == MOST_FREQUENT else mf.SQLTransformer(statement=f"SELECT *, {known} FROM __THIS__"))
        stages += [mf.StringIndexer(inputCols=[f"{c}_f" for c in texts], outputCols=[f"{c}_x" for c in texts], handleInvalid="keep"), mf.OneHotEncoder(inputCols=[f"{c}_x" for c in texts], outputCols=[f"{c}_o" for c in texts])]
    stages.append(mf.VectorAssembler(inputCols=[f"{c}_i" for c in numbers] + [f"{c}_o" for c in texts], outputCol="raw"))
    last = "raw"
    if scale:
        stages.append(SCALERS[scale]())
        last = "scaled"
    if components:
        stages.append(mf.PCA(k=components, inputCol=last, outputCol="reduced"))
        last = "reduced"
    stages.append(mf.SQLTransformer(statement=f"SELECT *, {last} AS features FROM __THIS__"))
    return Pipeline(stages=[*stages, CLASSIFIERS[classifier](**kw)])


def components_for(df: DataFrame, column: str, share: float) -> mf.PCAModel:
    """The PCA with the fewest components that explain a share of the variance."""
    size = len(df.select(column).first()[0])
    whole = mf.PCA(k=size, inputCol=column, outputCol=f"{column}_pca").fit(df)
    explained = whole.explainedVariance.toArray().cumsum()
    k = min(size, int((explained < share - 1e-12).sum()) + 1)
    return mf.PCA(k=k, inputCol=column, outputCol=f"{column}_pca").fit(df)


def loadings(model: mf.PCAModel, names: Sequence[str], most: int) -> list[list[tuple[str, float]]]:
    """For each component the names that weigh most in it, with their signed weights."""
    weights = model.pc.toArray()
    return [sorted(zip(names, map(float, weights[:, k]), strict=True), key=lambda x: -abs(x[1]))[:most] for k in range(weights.shape[1])]


def gram(df: DataFrame, column: str, size: int) -> np.ndarray:
    """The sum of x x^T over all vectors x: each task sums its own rows with numpy, the tasks' rows of the matrix are added by row, and the driver gets size x size numbers."""

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((size, size))
        for batch in batches:
            if len(batch):
                x = np.stack(batch["v"].to_list())
                total += x.T @ x
        yield pd.DataFrame({"i": range(size), "g": list(total)})

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": rows["i"].iloc[:1], "g": [np.sum(np.stack(rows["g"].to_list()), axis=0)]})

    parts = df.where(F.col(column).isNotNull()).select(vector_to_array(column).alias("v")).mapInPandas(summed, "i int, g array<double>")
    out = np.zeros((size, size))
    for row in parts.groupBy("i").applyInPandas(added, "i int, g array<double>").collect():
        out[row.i] = row.g
    return out


def truncated_svd(df: DataFrame, column: str, k: int, out: str) -> tuple[DataFrame, list[float]]:
    """df with its vectors projected on the first k right singular vectors, without centring, and the singular values; a null vector has none."""
    size = len(df.where(F.col(column).isNotNull()).select(column).first()[0])
    values, vectors = np.linalg.eigh(gram(df, column, size))
    order = np.argsort(-values)[:k]
    basis = vectors[:, order]

    def projected(rows: pd.Series) -> pd.Series:
        known = rows.notna().to_numpy()
        done = pd.Series([None] * len(rows), dtype=object)
        for at, v in zip(np.flatnonzero(known), np.stack(rows[known].to_list()) @ basis if known.any() else [], strict=True):
            done.iat[at] = v
        return done

    on = F.pandas_udf(projected, "array<double>")(F.when(F.col(column).isNotNull(), vector_to_array(column)))
    return df.withColumn(out, on), [float(np.sqrt(max(values[c], 0.0))) for c in order]


def as_numbers(df: DataFrame, leave: Sequence[str]) -> DataFrame:
    numbers, _ = columns(df, leave)
    return df.withColumns({c: F.col(c).cast("double") for c in numbers})


def predict(model: PipelineModel, df: DataFrame, id: str) -> DataFrame:
    return model.transform(df).select(id, "y", vector_to_array("probability")[1].alias("score"))


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """df with a weight by which both classes count alike; rows without a label get none."""
    n, positives = df.agg(F.count(label), F.sum(F.col(label).cast("long"))).first()
    each = F.when(F.col(label) > 0, n / (2 * max(positives or 0, 1))).when(F.col(label) <= 0, n / (2 * max(n - (positives or 0), 1)))
    return df.withColumn(out, each)


class Folds:
    """The rows of each fold and role, written once for all settings (in spark.checkpoint.dir; where that is unset, kept by Spark)."""

    def __init__(self, df: DataFrame, folds: DataFrame, id: str, leave: Sequence[str]):
        df = as_numbers(df, leave)
        self.id, (self.numbers, self.texts) = id, columns(df, leave)
        parts = df.join(folds.select(id, F.col("fold").alias("_fold"), F.col("role").alias("_role")), id)
        self.rows = materialized(parts, "folds")
        if self.rows is parts:
            self.rows = parts.persist()
        self.names = sorted(row[0] for row in folds.select("fold").distinct().collect())  # a row for each fold

    def score(self, settings: dict, k: int) -> float:
        """The average precision on a fold of what is fitted with the settings on the rows before it."""
        part = lambda role: self.rows.where((F.col("_fold") == self.names[k]) & (F.col("_role") == role)).drop("_fold", "_role")
        model = pipeline(self.numbers, self.texts, **settings).fit(part("train"))
        return evaluation.average_precision(predict(model, part("val"), self.id), "score", "y").first()[0] or 0.0


def search(df: DataFrame, folds: DataFrame, id: str, grid: Sequence[dict], leave: Sequence[str]) -> tuple[dict, float]:
    """The settings with the best mean average precision over the folds, and that mean."""
    held = Folds(df, folds, id, leave)
    trials = [tuning.Trial(settings, [held.score(settings, k) for k in range(len(held.names))]) for settings in grid]
    held.rows.unpersist()
    found = tuning.best(trials)
    return found.settings, found.mean


def tuned(df: DataFrame, folds: DataFrame, id: str, space: tuning.Space, leave: Sequence[str], trials: int, **kw) -> list[tuning.Trial]:
    """The trials of a search by tree-structured Parzen estimators, scored fold by fold; `tuning.best` picks one."""
    held = Folds(df, folds, id, leave)
    done = tuning.optimise(space, held.score, len(held.names), trials, **kw)
    held.rows.unpersist()
    return done


def correlation(df: DataFrame, names: Sequence[str], least: float) -> list[tuple[str, str, float]]:
    """Pairs of columns whose correlation is at least that far from 0."""
    v = mf.VectorAssembler(inputCols=list(names), outputCol="v").transform(df.na.fill(0.0, list(names)))
    m = Correlation.corr(v, "v").first()[0].toArray()
    return [(a, b, float(m[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if i < j and abs(m[i, j]) >= least]


def importances(model: PipelineModel, numbers: Sequence[str], texts: Sequence[str], most: int) -> list[tuple[str, float]]:
    """The features that the trees use most, with the slots of a text column together."""
    trees = model.stages[-1]
    values = trees.featureImportances.toArray()
    sizes = [1] * len(numbers) + [len(x) for stage in model.stages if isinstance(stage, mf.StringIndexerModel) for x in stage.labelsArray]
    at, out = 0, []
    for name, n in zip([*numbers, *texts], sizes, strict=True):
        out.append((name, float(values[at : at + n].sum())))
        at += n
    return sorted(out, key=lambda x: -x[1])[:most]


def feature_changes(before: Sequence[str], now: Sequence[str]) -> dict[str, list[str]]:
    return {"added": sorted(set(now) - set(before)), "removed": sorted(set(before) - set(now))}


def held_matrix(t) -> DataFrame:
    """The feature matrix, worked out once for all passes of a fit (in spark.checkpoint.dir; where that is unset, kept by Spark)."""
    from tidemark.plans import features

    m = features.matrix(t)
    held = materialized(m, "matrix")
    return m.persist() if held is m else held


def fitted(t):
    """(feature matrix, trees that are fitted on its train split, names of the features)."""
    leave = ("o_orderkey", "y", "split")
    m = as_numbers(held_matrix(t), leave)
    numbers, texts = columns(m, leave)
    model = pipeline(numbers, texts).fit(m.where("split = 'train'"))
    known = [x for stage in model.stages if isinstance(stage, mf.StringIndexerModel) for x in stage.labelsArray]
    return m, model, [*numbers, *(f"{c}={v}" for c, labels in zip(texts, known, strict=True) for v in labels)]


@query()
def tree_attributions(t):
    """What each feature adds to the margins of the test split: the mean absolute Shapley value, and its share."""
    m, model, names = fitted(t)
    found = attribution.leaves(m.sparkSession, model.stages[-1])
    scored = model.transform(m.where("split = 'test'")).select(attribution.attributed(found, F.col("features")).alias("a"))
    return attribution.mean_absolute(scored, "a", names).select("feature", r("attribution").alias("attribution"), r("share").alias("share"))


@query()
def trained_scores(t):
    """Scores of the test split by trees that are fitted on the train split of the feature matrix."""
    m, model, _ = fitted(t)
    return predict(model, m.where("split = 'test'"), "o_orderkey").select("o_orderkey", "y", r("score").alias("score"))


@query()
def tuned_settings(t):
    """Trials of a search over the boosted trees' settings on expanding folds of the train split: settings, mean average precision, whether it was cut."""
    m = held_matrix(t).where("split = 'train'")
    times = t("orders").select("o_orderkey", F.col("o_orderdate").alias("_time"))
    folds = evaluation.expanding_folds(m.select("o_orderkey").join(times, "o_orderkey"), "_time", "o_orderkey", 2, 30)
    space = {"maxIter": tuning.Range(2, 6, whole=True), "maxDepth": tuning.Range(2, 4, whole=True), "stepSize": tuning.Range(0.05, 0.5, log=True)}
    done = tuned(m, folds, "o_orderkey", space, ("o_orderkey", "y", "split"), trials=4, start=3, prune_after=2, patience=3)
    rows = [(k, x.settings["maxIter"], x.settings["maxDepth"], round(x.settings["stepSize"], 6), len(x.scores), round(x.mean, 6), x.cut) for k, x in enumerate(done)]
    return m.sparkSession.createDataFrame(rows, "trial int, trees int, depth int, step double, folds int, mean_precision double, cut boolean")


def lines_with_gaps(t) -> tuple[DataFrame, im.NearestModel]:
    """(quantity, price and discount of every line, of which one is left out of some lines in turn; the imputer fitted on 2000 lines)."""
    rows = t("lineitem").withColumn("k", F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(20)))
    scaled = {"quantity": F.col("l_quantity").cast("double") / 50, "price": F.col("l_extendedprice").cast("double") / 100_000, "discount": F.col("l_discount").cast("double") * 10}
    rows = rows.select("l_orderkey", "l_linenumber", *(F.when(F.col("k") != n, x).alias(name) for n, (name, x) in enumerate(scaled.items())))
    return rows, im.NearestImputer(list(scaled), donors=2000, drawn_by=["l_orderkey", "l_linenumber"]).fit(rows)


@query()
def nearest_imputed(t):
    """Quantity, price and discount of every line, with the gaps filled from the nearest lines."""
    rows, model = lines_with_gaps(t)
    return model.transform(rows).select("l_orderkey", "l_linenumber", *(r(f"{c}_i").alias(c) for c in ("quantity", "price", "discount")))


@query("""
    WITH o AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS p, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS s FROM orders),
    most_p AS (SELECT p AS v FROM o WHERE p IS NOT NULL GROUP BY p ORDER BY count(*) DESC, p LIMIT 1),
    most_s AS (SELECT s AS v FROM o WHERE s IS NOT NULL GROUP BY s ORDER BY count(*) DESC, s LIMIT 1)
    SELECT o_orderkey, coalesce(p, (SELECT v FROM most_p)) AS priority, coalesce(s, (SELECT v FROM most_s)) AS status FROM o""")
def frequent_imputed(t):
    """Priority and status of every order, of which some are left out, filled with the most frequent value."""
    rows = t("orders").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END").alias("p"), F.expr("CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END").alias("s"))
    done = im.FrequentImputer(["p", "s"]).fit(rows).transform(rows)
    return done.select("o_orderkey", F.col("p_f").alias("priority"), F.col("s_f").alias("status"))
