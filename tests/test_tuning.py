import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import evaluation, impute, tuning
from tidemark.plans import training

SPACE = {"x": tuning.Range(0, 1), "y": tuning.Range(1e-4, 1.0, log=True), "n": tuning.Range(1, 9, whole=True), "c": tuning.Choice(("a", "b", "c"))}


def planted(s, fold=0):
    return -((s["x"] - 0.3) ** 2) - (np.log10(s["y"]) + 2) ** 2 / 16 - (s["n"] - 6) ** 2 / 64 - 0.3 * (s["c"] != "b") + 0.001 * fold


def test_settings_stay_in_their_space_and_depend_on_the_seed_only():
    a = tuning.optimise(SPACE, planted, 2, 30, seed=3)
    assert [t.settings for t in a] == [t.settings for t in tuning.optimise(SPACE, planted, 2, 30, seed=3)] != [t.settings for t in tuning.optimise(SPACE, planted, 2, 30, seed=4)]
    for t in a:
        assert 0 <= t.settings["x"] <= 1 and 1e-4 <= t.settings["y"] <= 1 and t.settings["n"] in range(1, 10) and t.settings["c"] in "abc"
    for s in (tuning.Range(2, 7, whole=True), tuning.Range(1e-3, 10, log=True), tuning.Range(-5, 5)):
        assert all(abs(s.value(s.place(v)) - v) < 1e-9 for v in (s.low, s.high))
    assert tuning.Range(4, 4).value(tuning.Range(4, 4).place(4)) == 4


def test_better_than_random_on_a_planted_optimum():
    wins, gap = 0, []
    for seed in range(20):
        guided = tuning.best(tuning.optimise(SPACE, planted, 1, 30, seed=seed)).mean
        chance = tuning.best(tuning.optimise(SPACE, planted, 1, 30, seed=seed, start=30)).mean
        wins += guided > chance
        gap.append(guided - chance)
    assert wins >= 14 and np.mean(gap) > 0.01


def test_trials_behind_the_median_are_cut_and_never_best():
    asked = []

    def score(s, k):
        asked.append(k)
        return planted(s, k)

    done = tuning.optimise(SPACE, score, 3, 40, seed=1)
    cut = [t for t in done if t.cut]
    assert cut and all(len(t.scores) < 3 for t in cut) and not tuning.best(done).cut
    assert sum(len(t.scores) for t in done) < 3 * len(done) and len(asked) <= sum(len(t.scores) for t in done)
    assert not any(t.cut for t in done[:5])
    assert tuning.best(done).mean == max(t.mean for t in done if not t.cut)
    flat = tuning.optimise(SPACE, lambda s, k: 1.0, 2, 40, patience=4)
    assert len(flat) == 5


def test_tuned_on_folds(spark):
    rng = np.random.default_rng(2)
    rows = [(k, float(k), float(rng.random()), float(rng.random()), "ab"[k % 2]) for k in range(400)]
    df = spark.createDataFrame([(*r, int(abs(r[2] - 0.5) + 0.4 * (r[4] == "a") > 0.5)) for r in rows], "id long, t double, x double, z double, c string, y int")
    folds = evaluation.expanding_folds(df.withColumn("t", F.timestamp_seconds("t")), "t", "id", 2, 0)
    space = {"maxIter": tuning.Range(1, 3, whole=True), "maxDepth": tuning.Range(1, 3, whole=True)}
    done = training.tuned(df, folds, "id", space, ("id", "y", "t"), trials=4, start=2, prune_after=2)
    assert len(done) == 4 and tuning.best(done).mean > 0.8
    weighted = training.class_weights(df.withColumn("y", (F.col("id") % 4 == 0).cast("int")), "y")
    assert {(r.y, round(r.weight, 6)) for r in weighted.select("y", "weight").distinct().collect()} == {(1, 2.0), (0, round(400 / 600, 6))}
    noisy = training.class_weights(df.withColumn("val", F.col("id") >= 250).withColumn("y", F.when(F.rand(3) < 0.4, 1 - F.col("y")).otherwise(F.col("y"))), "y")
    model = training.pipeline(["x", "z"], ["c"], maxIter=30, validationIndicatorCol="val", weightCol="weight", impute="nearest", missing=training.MOST_FREQUENT).fit(noisy)
    assert model.stages[-1].getNumTrees < 30


def plain(rows, donors, k, means):
    """One value after the other, from the definition."""
    out = [list(r) for r in rows]
    for r, row in enumerate(rows):
        for c, v in enumerate(row):
            if v is not None:
                continue
            near = []
            for at, d in enumerate(donors):
                both = [(a - b) ** 2 for a, b in zip(row, d, strict=True) if a is not None and b is not None]
                if d[c] is not None and both:
                    near.append((sum(both) / len(both), at, d[c]))
            near.sort()
            out[r][c] = sum(x for *_, x in near[:k]) / len(near[:k]) if near else means[c]
    return out


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    values = rng.integers(0, 12, (600, 4)).astype(float) * [1, 1, 0.5, 1000]  # many ties
    values[300:] = rng.normal(size=(300, 4)) * [5, 1, 1, 1e3] + [0, 1e6, 0, 0]
    data = [[None if rng.random() < 0.2 else float(v) for v in row] for row in values]
    data[0], data[1] = [None] * 4, [None, None, None, 7.0]
    df = spark.createDataFrame([(k, *row) for k, row in enumerate(data)], "id long, a double, b double, c double, d double")
    df = df.withColumn("a", F.when(F.col("id") == 5, F.lit(float("nan"))).otherwise(F.col("a")))
    data[5][0] = None
    model = impute.NearestImputer(["a", "b", "c", "d"], drawn_by=["id"]).fit(df)
    assert len(model.donors) == sum(any(x is not None for x in r) for r in data)
    donors = [[None if np.isnan(x) else float(x) for x in row] for row in model.donors]
    assert sorted(map(str, donors)) == sorted(str(r) for r in data if any(x is not None for x in r))
    means = [np.mean([d[c] for d in donors if d[c] is not None]) for c in range(4)]
    got = [[r.a_i, r.b_i, r.c_i, r.d_i] for r in model.transform(df).orderBy("id").collect()]
    assert np.allclose(np.array(got, float), np.array(plain(data, donors, 5, means), float), rtol=1e-12, atol=1e-9)
    assert len(impute.NearestImputer(["a"], donors=50, drawn_by=["id"]).fit(df).donors) == 50
    none = impute.NearestImputer(["a", "b"]).fit(df.limit(0).select("id", "a", "b"))
    assert none.transform(df.where("id = 1")).first().b_i is None and none.transform(df.limit(0)).count() == 0


def test_nearest_are_measured_by_the_block(monkeypatch):
    rng = np.random.default_rng(3)
    rows, donors = rng.integers(0, 9, (1000, 3)).astype(float), rng.integers(0, 9, (700, 3)).astype(float)
    rows[np.arange(900), np.arange(900) % 3] = np.nan
    donors[::7, 1] = np.nan
    calls, summed = [], np.nansum
    monkeypatch.setattr(np, "nansum", lambda *a, **b: calls.append(1) or summed(*a, **b))
    means = np.nanmean(donors, 0)
    got = impute.filled(rows, donors, 5, means)
    none = lambda m: [[None if np.isnan(x) else float(x) for x in r] for r in m]
    assert np.allclose(got, np.array(plain(none(rows), none(donors), 5, means)), rtol=1e-12)
    assert len(calls) < 50


def test_most_frequent_text(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None), ("b", None), ("a", None)], "s string, n string")
    model = impute.FrequentImputer(["s", "n"]).fit(df)
    assert model.values == {"s": "a", "n": "missing"} and {r.s_f for r in model.transform(df.where("s IS NULL")).collect()} == {"a"}


def test_registered_queries(spark, sf):
    import __spark_entry__ as entry

    rows, model = training.lines_with_gaps(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))
    names = ["quantity", "price", "discount"]
    given = [[r.l_orderkey, r.l_linenumber, *(r[c] for c in names)] for r in rows.collect()]
    got = entry.queries()["nearest_imputed"](spark, sf).collect()
    assert len(got) == len(given) > 1000
    donors = [[None if np.isnan(x) else float(x) for x in d] for d in model.donors]
    assert len(donors) == 2000
    gaps = [g for g in given if any(x is None for x in g[2:])][:60]
    want = plain([g[2:] for g in gaps], donors, 5, model.means)
    found = {(r.l_orderkey, r.l_linenumber, *(r[c] for c in names)) for r in got}
    near = lambda g, w: any(k[:2] == (g[0], g[1]) and np.allclose(k[2:], w, atol=2e-6) for k in found)
    assert all(near(g, w) for g, w in zip(gaps, want, strict=True))
    done = entry.queries()["tuned_settings"](spark, sf).collect()
    assert [r.trial for r in done] == list(range(len(done))) and max(r.mean_precision for r in done) > 0
