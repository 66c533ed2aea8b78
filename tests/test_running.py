"""Running values of keys of any size, against plain Python."""

import datetime as dt
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation, joins, running

DAY = dt.date(2024, 1, 1)


def data(rng, n, values):
    return [(k, rng.choice("aab") if k % 17 else None, rng.choice("xyz"), DAY + dt.timedelta(days=rng.randrange(12)), rng.choice(values) if rng.random() < 0.9 else None) for k in range(n)]


def earlier(rows, key):
    """(row, values of the earlier rows of its key) by day and id."""
    seen = {}
    for r in sorted(rows, key=lambda r: (r[3], r[0])):
        yield r, list(seen.setdefault(key(r), []))
        if r[4] is not None:
            seen[key(r)].append(r[4])


KIND = "id long, g string, h string, day date, v double"
RNG = random.Random(5)


@pytest.mark.parametrize("values", [[RNG.gauss(1e6, 3) for _ in range(300)], [0.0] * 40 + [1.0] * 9 + [float(k) for k in range(30)]], ids=["many", "common"])
@pytest.mark.parametrize("cell, asked", [(4096, 20_000), (20, 15)])
def test_median(spark, monkeypatch, values, cell, asked):
    monkeypatch.setattr(running, "CELL", cell)
    monkeypatch.setattr(running, "ASKED", asked)
    rows = data(random.Random(2), 500, values)
    df = spark.createDataFrame(rows, KIND)
    got = {r.id: r.middle for r in running.median(df, ["g"], ["day", "id"], F.col("day"), "v", "middle").collect()}
    want = {r[0]: statistics.median(x) if x else None for r, x in earlier(rows, lambda r: r[1])}
    assert got.keys() == want.keys()
    assert all(a == b or abs(a - b) < 1e-9 * max(1, abs(b)) for a, b in ((got[k], want[k]) for k in want))
    assert running.median(df.limit(0), ["g"], ["day", "id"], F.col("day"), "v", "middle").count() == 0


def test_levels_from_one_pass(spark):
    rows = data(random.Random(3), 400, [RNG.gauss(1e7, 2) for _ in range(300)])
    df = spark.createDataFrame(rows, KIND)
    levels = {"fine": ["g", "h"], "coarse": ["g"], "all": []}
    done = running.before(df, levels, ["day", "id"], F.col("day"), {"v": F.col("v")})
    stats = [x for level in levels for x in (F.col(f"{level}_v_n"), running.mean(f"{level}_v"), running.stddev(f"{level}_v"), F.col(f"{level}_v_max"))]
    got = {r[0]: tuple(r)[1:] for r in done.select("id", *stats).collect()}
    assert len(got) == len(rows)
    for at, key in enumerate((lambda r: (r[1], r[2]), lambda r: r[1], lambda r: 0)):
        for r, x in earlier(rows, key):
            n, mean, spread, most = got[r[0]][4 * at : 4 * at + 4]
            assert n == len(x)
            assert (mean is None) == (not x) and (not x or abs(mean - statistics.fmean(x)) < 1e-6 and abs(most - max(x)) < 1e-6)
            assert (spread is None) == (len(x) < 2) and (len(x) < 2 or abs(spread - statistics.stdev(x)) < 1e-5)


def test_no_task_holds_a_key(spark):
    """The physical plan has no window by the key alone over rows: each window over rows is by bucket too."""
    df = spark.createDataFrame(data(random.Random(4), 50, [1.0, 2.0]), KIND)
    plan = running.before(df, {"coarse": ["g"]}, ["day", "id"], F.col("day"), {"v": F.col("v")})._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x and "id#" in x.split("windowspecdefinition")[1]]
    assert windows and all("windowspecdefinition(_b#" in x for x in windows)


def test_asof_of_a_key_with_most_rows(spark):
    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    at = lambda: rng.choice([start + dt.timedelta(hours=rng.randrange(24 * 40)), None]) if rng.random() < 0.1 else start + dt.timedelta(hours=rng.randrange(24 * 40))
    user = lambda: "hot" if rng.random() < 0.9 else rng.choice(["a", "b", None])
    left = [(k, user(), at()) for k in range(400)]
    right = [(user(), at(), k, rng.choice([k, None])) for k in range(150)]
    l, r = spark.createDataFrame(left, "id long, u string, t timestamp_ntz"), spark.createDataFrame(right, "u string, s timestamp_ntz, k long, x long")  # noqa: E741
    low = lambda t: (t is not None, t or start)
    want = {}
    for i, u, t in left:
        mine = [y for y in right if y[0] == u and low(y[1]) <= low(t)]
        want[i] = max(mine, key=lambda y: (low(y[1]), y[2]))[2:] if mine else None
    for piece in (None, lambda t: F.date_trunc("hour", t), lambda t: F.lit(1)):
        done = joins.asof_join(l, r, ["u"], "t", "s", ["k", "x"], ["k"], inner=False, piece=piece)
        assert {y.id: (y.k, y.x) if y.k is not None else None for y in done.collect()} == want
    plan = joins.asof_join(l, r, ["u"], "t", "s", ["k"], ["k"])._jdf.queryExecution().optimizedPlan().toString()
    rows = [y for y in plan.split("\n") if "Window [" in y and "_side#" in y.split("windowspecdefinition")[1]]
    assert rows and all("_piece#" in y.split("windowspecdefinition")[1].split("ASC")[0] for y in rows)


def test_ties_of_a_score_are_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(evaluation, "TIED", 20)
    rng = random.Random(9)
    data = [(k * 7 - 900, rng.choice([0.5, 0.50001, 0.50003, 0.2, rng.random(), None]), int(rng.random() < 0.4)) for k in range(600)]
    df = spark.createDataFrame(rng.sample(data, 600), "id long, s double, y int")
    order = sorted(data, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    hits, want = 0, {}
    for k, (i, _, y) in enumerate(order, 1):
        hits += y
        want[i] = (k, hits)
    done = evaluation.ranked(df, "s", "y", "id")
    assert done.columns == ["id", "s", "y", "place", "hits"]
    assert {r.id: (r.place, r.hits) for r in done.collect()} == want
    named = evaluation.ranked(df.withColumn("id", F.col("id").cast("string")), "s", "y", "id").collect()
    assert sorted(r.place for r in named) == list(range(1, 601))


def test_medians_while_values_come_and_go():
    """Of a line of which only the middle is held, with values that are there often."""
    rng = random.Random(9)
    for values in (range(1000), range(4)):
        earlier_ones, new = sorted(rng.choice(values) for _ in range(200)), [rng.choice([*values, None]) for _ in range(30)]
        low, high = 200 // 2 - 15 - 2, 200 // 2 + 15 + 3
        got = running._medians(np.array(earlier_ones[low:high], float), low, 200, np.array([np.nan if x is None else x for x in new], float), np.array([x is not None for x in new]))
        assert got.tolist() == [statistics.median(earlier_ones + [x for x in new[:k] if x is not None]) for k in range(30)]


def test_rows_are_dealt_out_once_for_a_median(spark):
    """What else is shuffled are lists of cells and the few values in the middle; rows without a day are the last."""
    days = 400
    rows = [(k, "ab"[k % 2], DAY + dt.timedelta(days=k * 7919 % days) if k % 13 else None, (k * 104729 % 10007) / 7) for k in range(6_000)]
    df = spark.createDataFrame(rows, "id long, g string, day date, v double")
    bucket = F.floor(F.datediff("day", F.lit(DAY)) / 40).cast("int")
    done = running.median(df, ["g"], ["day", "id"], bucket, "v", "middle")
    seen, want = {"a": [], "b": []}, {}
    for k, g, day, v in sorted(rows, key=lambda r: (r[2] is None, r[2] or DAY, r[0])):
        want[k] = statistics.median(seen[g]) if seen[g] else None
        seen[g].append(v)
    assert {r.id: r.middle for r in done.collect()} == want
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "id#" in plan and not [x for x in plan.split("\n") if "Join" in x and "id#" in x]
