"""Shapley values of trees against their definition."""

import random
from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml import feature as mf
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from tidemark.operators import attribution as A

SIZE = 6


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    x = [[rng.random(), rng.random(), float(rng.randrange(4)), rng.random(), float(rng.randrange(3)), rng.random()] for _ in range(400)]
    data = [(k, *v, float(v[0] + v[1] * v[3] + (v[2] in (1, 3)) * 0.7 + (v[4] == 2) * v[5] > 1.2)) for k, v in enumerate(x)]
    df = spark.createDataFrame(data, "id long, " + ", ".join(f"f{k} double" for k in range(SIZE)) + ", y double")
    plain = mf.VectorAssembler(inputCols=[f"f{k}" for k in range(SIZE)], outputCol="raw").transform(df)
    return mf.VectorIndexer(inputCol="raw", outputCol="features", maxCategories=4).fit(plain).transform(plain).cache()


def known(found, x, some):
    """The value of a row of which only the features in `some` are known."""
    total = 0.0
    for v, names, shares, conditions in found:
        for f, z, each in zip(names, shares, conditions, strict=True):
            v *= float(all((x[f] <= t if c is None else x[f] in c) == left for t, c, left in each)) if f in some else z
        total += v
    return total


def shapley(found, x):
    out = []
    for i in range(SIZE):
        rest = [k for k in range(SIZE) if k != i]
        out.append(sum(factorial(n) * factorial(SIZE - 1 - n) / factorial(SIZE) * (known(found, x, {*s, i}) - known(found, x, {*s})) for n in range(SIZE) for s in combinations(rest, n)))
    return out


def test_equal_to_the_definition_and_sums_to_the_margin(spark, rows):
    model = GBTClassifier(labelCol="y", maxIter=4, maxDepth=4, seed=3).fit(rows)
    found = A.leaves(spark, model)
    assert any(c is not None for *_, conditions in found for each in conditions for _, c, _ in each)  # categories too
    got = model.transform(rows).withColumn("a", A.attributed(found, F.col("features"))).select("features", "rawPrediction", "a").collect()
    for r in got:
        assert abs(sum(r.a) + A.expected(found) - r.rawPrediction[1]) < 1e-9
    for r in got[:12]:
        assert np.allclose(r.a, shapley(found, r.features.toArray()), atol=1e-10)


def test_one_tree_and_null_vectors(spark, rows):
    model = DecisionTreeRegressor(labelCol="y", maxDepth=3, seed=3).fit(rows)
    found = A.leaves(spark, model)
    df = model.transform(rows).withColumn("v", F.when(F.col("id") != 5, F.col("features"))).withColumn("a", A.attributed(found, F.col("v")))
    got = df.select("id", "prediction", "a").collect()
    assert all((r.a is None) == (r.id == 5) for r in got)
    assert all(abs(sum(r.a) + A.expected(found) - r.prediction) < 1e-9 for r in got if r.a is not None)
    means = A.mean_absolute(df, "a", [f"f{k}" for k in range(SIZE)]).collect()
    assert {r.feature for r in means} == {f"f{k}" for k in range(SIZE)} and abs(sum(r.share for r in means) - 1) < 1e-9
    want = np.mean([np.abs(r.a) for r in got if r.a is not None], axis=0)
    assert np.allclose([r.attribution for r in sorted(means, key=lambda r: r.feature)], want)
    assert A.mean_absolute(df.limit(0), "a", ["f0"]).count() == 0
