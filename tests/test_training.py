import random

from pyspark.sql import functions as F

from tidemark.operators import evaluation
from tidemark.plans import training


def test_pipeline_learns_and_explains(spark):
    rng = random.Random(1)
    data = [(k, float(k), rng.choice([None, rng.random()]), rng.choice("ab"), k % 2 == 0) for k in range(300)]
    data = [(*d, int((d[2] or 0.5) + (d[3] == "a") * 0.8 + rng.random() * 0.2 > 0.9)) for d in data]
    df = spark.createDataFrame(data, "id long, t double, x double, c string, flag boolean, y int")
    leave = ("id", "y", "t")
    df = training.as_numbers(df, leave)
    numbers, texts = training.columns(df, leave)
    assert numbers == ["x", "flag"] and texts == ["c"]
    model = training.pipeline(numbers, texts, maxIter=3).fit(df.where("id < 200"))
    got = training.predict(model, df.where("id >= 200"), "id")
    assert evaluation.average_precision(got, "score", "y").first()[0] > 0.8
    top = training.importances(model, numbers, texts, 2)
    assert {n for n, _ in top} == {"x", "c"}
    for scale in training.SCALERS:
        training.pipeline(numbers, texts, impute="mean", scale=scale, components=2, classifier="logistic").fit(df.where("id < 50"))
    folds = evaluation.expanding_folds(df.where("id < 200").withColumn("t", F.timestamp_seconds("t")), "t", "id", 1, 0)
    best, mean = training.search(df, folds, "id", [{"maxIter": 1, "maxDepth": 1}, {"maxIter": 3, "maxDepth": 3}], leave)
    assert best["maxIter"] == 3 and mean > 0.7
    assert training.correlation(df.selectExpr("t", "-t AS u", "coalesce(x, 0) AS x"), ["t", "u", "x"], 0.9) == [("t", "u", -1.0)]
    assert training.feature_changes(["a", "b"], ["b", "c"]) == {"added": ["c"], "removed": ["a"]}


def test_imputers_components_and_svd(spark):
    import numpy as np
    from pyspark.ml import feature as mf

    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4)) * [5, 3, 0.1, 0.01]
    df = spark.createDataFrame([(k, None if k % 9 == 0 else float(r[0]), float(r[1]), float(r[2]), float(r[3]), None if k % 5 == 0 else "ab"[k % 2], int(k % 2)) for k, r in enumerate(x)], "id long, a double, b double, c double, d double, s string, y int")
    model = training.pipeline(["a", "b", "c", "d"], ["s"], impute=-1.0, maxIter=2).fit(df)
    done = model.transform(df)
    assert {r.a_i for r in done.where("a IS NULL").collect()} == {-1.0} and {r.s_f for r in done.where("s IS NULL").collect()} == {"missing"}
    v = mf.VectorAssembler(inputCols=["a_i", "b", "c", "d"], outputCol="v").transform(done.select("id", "a_i", "b", "c", "d"))
    pca = training.components_for(v, "v", 0.999)
    assert pca.getK() == 2 and training.loadings(pca, ["a", "b", "c", "d"], 1)[0][0][0] == "a"
    got, values = training.truncated_svd(v, "v", 2, "p")
    plain = np.array([r.v.toArray() for r in v.orderBy("id").collect()])
    _, want, vt = np.linalg.svd(plain, full_matrices=False)
    assert np.allclose(values, want[:2]) and np.allclose(np.abs([r.p for r in got.orderBy("id").collect()]), np.abs(plain @ vt[:2].T))


def test_svd_of_many_columns(spark):
    import numpy as np
    from pyspark.ml.linalg import Vectors

    x = np.random.default_rng(1).normal(size=(300, 500)) * np.linspace(3, 0.1, 500)
    df = spark.createDataFrame([(k, Vectors.dense(v) if k else None) for k, v in reversed(list(enumerate([x[0], *x])))], ["id", "v"])
    done, values = training.truncated_svd(df, "v", 5, "p")
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert np.allclose(values, s[:5])
    got = {r.id: r.p for r in done.select("id", "p").collect()}
    assert got[0] is None
    mine = np.array([got[k + 1] for k in range(300)])
    assert np.allclose(np.abs(mine), np.abs(u[:, :5] * s[:5]), atol=1e-6)


def test_attributions_of_the_test_split(spark, sf):
    import __spark_entry__ as entry

    rows = entry.queries()["tree_attributions"](spark, sf).collect()
    assert len(rows) == len({r.feature for r in rows}) > 3 and abs(sum(r.share for r in rows) - 1) < 1e-3
