"""Small hand-made cases and properties of the operators."""

import datetime as dt
import random
import statistics

from pyspark.sql import functions as F

from tidemark.functions import arrays, times
from tidemark.operators import consensus, entropy, evaluation, graph, joins, shrink
from tidemark.operators import windows as W

DAY = dt.datetime(2024, 1, 1)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


VOTES = "item long, created timestamp_ntz, time timestamp_ntz, path array<struct<node:string,level:int>>, vote long, user long"


def agree(spark, votes, days):
    """votes: (days after creation, path of nodes)."""
    path = {
        "S1": [("S1", 10), ("G", 20), ("F", 30)], "S2": [("S2", 10), ("G", 20), ("F", 30)],
        "S1a": [("S1a", 5), ("G", 20), ("F", 30)], "S1b": [("S1b", 5), ("G", 20), ("F", 30)],
    }
    data = [(1, DAY, DAY + dt.timedelta(days=d), path[n], k, 100 + k) for k, (d, n) in enumerate(votes)]
    df = spark.createDataFrame(data, VOTES)
    got = consensus.at(consensus.timeline(df), days).collect()
    assert not got or (got[0].user == 100 + got[0].vote and got[0].decided == data[got[0].vote][2])
    return (got[0].node, (got[0].decided - DAY).days) if got else None


def test_consensus_cases(spark):
    assert agree(spark, [(0, "S1")], 7) is None
    assert agree(spark, [(0, "S1"), (1, "S1")], 7) == ("S1", 1)
    assert agree(spark, [(0, "S2"), (1, "S1"), (2, "S1")], 7) == ("S1", 2)
    assert agree(spark, [(0, "S1"), (1, "S2")], 7) == ("G", 1)
    assert agree(spark, [(0, "S1"), (9, "S1")], 7) is None
    assert agree(spark, [(0, "S1"), (9, "S1")], 30) == ("S1", 9)
    assert agree(spark, [(0, "S1"), (1, "S1"), (2, "S2"), (3, "S2")], 7) == ("S1", 1)
    assert agree(spark, [(0, "S1"), (0, "S1")], 7) == ("S1", 0)
    assert agree(spark, [(0, "S1"), (9, "S1")], None) == ("S1", 9)


def test_a_late_candidate_does_not_count_before_it_is_named(spark):
    sub = [("S1a", 5), ("S1", 10), ("G", 20)], [("S1b", 5), ("S1", 10), ("G", 20)], [("S1", 10), ("G", 20)]
    data = [(1, DAY, DAY + dt.timedelta(days=d), p, d, 7) for d, p in zip((0, 1, 9), sub, strict=True)]
    schema = VOTES
    steps = consensus.timeline(spark.createDataFrame(data, schema))
    for days in (0, 1, 5, 9, 30):
        cut = [v for v in data if (v[2] - DAY).days <= days]
        want = rows(consensus.at(consensus.timeline(spark.createDataFrame(cut, schema)), None))
        assert rows(consensus.at_each(steps, [days]).drop("days")) == want
        assert rows(consensus.at(steps, days)) == want


def test_asof(spark):
    left = spark.createDataFrame([(1, 5), (1, 7), (2, 1), (None, 3)], "k long, t long")
    right = spark.createDataFrame([(1, 4, "p"), (1, 6, "r"), (1, 6, "q"), (1, 8, "s"), (None, 3, "n")], "k long, s long, v string")
    got = joins.asof_join(left, right, ["k"], "t", "s", ["v"], ["v"])
    assert sorted(got.collect(), key=str) == sorted([(1, 5, "p"), (1, 7, "r"), (None, 3, "n")], key=str)
    assert joins.asof_join(left, right, ["k"], "t", "s", ["v"], ["v"], inner=False).count() == 4
    assert joins.asof_join(left, right.limit(0), ["k"], "t", "s", ["v"], ["v"]).count() == 0


def test_history_leaves_out_the_current_row(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate((4, 1, 9, 5))], "k long, t long, v long")
    w = W.before(["k"], ["t"])
    got = df.select("t", F.percentile("v", F.lit(0.5)).over(w).alias("m"), F.stddev_samp("v").over(w).alias("s"), F.count("v").over(w).alias("n")).orderBy("t").collect()
    assert [x.m for x in got] == [None, 4, 2.5, 4] and [x.n for x in got] == [0, 1, 2, 3]
    assert [x.s and round(x.s, 4) for x in got] == [None, None, 2.1213, 4.0415]


def test_running_distinct_and_entropy_equal_brute_force(spark):
    rng = random.Random(2)
    data = [(rng.randrange(3), k, rng.choice(["a", "b", "c", None])) for k in range(60)]
    df = spark.createDataFrame(data, "u long, t long, v string")
    got = {x.t: x for x in entropy.running_entropy(W.running_distinct(df, ["u"], "v", ["t"], "d"), ["u"], "v", ["t"], "h").collect()}
    for u, t, _ in data:
        before = [v for a, b, v in data if a == u and b < t]
        known = [v for v in before if v]
        assert got[t].d == len(set(known)) == got[t].h_kinds
        if not before:
            assert got[t].h is None
            continue
        import math

        share = [known.count(v) / len(before) for v in set(known)]
        assert abs(got[t].h + sum(p * math.log2(p) for p in share)) < 1e-9


def test_later_rows_change_nothing(spark):
    data = [(k % 3, k, float(k * 7 % 11)) for k in range(30)]
    w = W.before(["u"], ["t"])
    make = lambda d: spark.createDataFrame(d, "u long, t long, v double").select("t", F.avg("v").over(w).alias("a"), F.count("v").over(w).alias("n"))
    later = make(data + [(k % 3, 100 + k, 1e9) for k in range(9)]).where("t < 100")
    assert rows(make(data).na.fill(-1)) == rows(later.na.fill(-1))


def test_running_total_equals_a_global_window(spark):
    data = [(k, k % 4, float(k)) for k in range(20)] + [(20, None, 1.0)]
    df = spark.createDataFrame(data, "id long, t long, v double")
    got = {x.id: x.s for x in W.running_total(df, "t", "id", {"s": F.col("v")}).collect()}
    halves = W.running_total(df, "t", "id", {"s": F.col("v")}, bucket=F.floor(F.col("t") / 2))
    assert got == {x.id: x.s for x in halves.collect()}
    order = sorted(data, key=lambda d: (d[1] is not None, d[1] or 0, d[0]))
    assert got == {d[0]: sum(x[2] for x in order[:k]) for k, d in enumerate(order)}


def test_shrinkage_and_priors(spark):
    df = spark.createDataFrame([(3, 5, 10, 25, 40, 60), (0, 0, 1, 3, 10, 49)], "k long, n long, k2 long, n2 long, k3 long, n3 long")
    prior, source = shrink.prior_of([(F.col("k2"), F.col("n2"), 20), (F.col("k3"), F.col("n3"), 50)], F.lit(0.5))
    got = df.select(shrink.shrunk(F.col("k"), F.col("n"), F.lit(0.4), 5), prior, source).collect()
    assert [tuple(x) for x in got] == [(0.5, 0.4, 1), (0.4, 0.5, 3)]


def test_percent_rank_puts_nulls_last(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 3)], "i int, v int")
    got = df.select("i", F.percent_rank().over(W.ordered([], ["v"])).alias("p")).orderBy("i").collect()
    assert [x.p for x in got] == [0.0, 1.0, 0.5]


def test_graph_cases(spark):
    e = spark.createDataFrame([("A", "B"), ("A", "C"), ("B", "C"), ("C", "D")], "src string, dst string")
    assert [x for x in rows(graph.two_hops(e)) if x[0] == "A"] == [("A", "B", "C"), ("A", "C", "D")]
    assert [x for x in rows(graph.exclusive_two_hops(e)) if x[0] == "A"] == [("A", "D")]
    assert {x.node: (x.pairs, x.connected) for x in graph.clustering(e).collect()}["A"] == (2, 1)
    assert {x.node: x.magnet for x in graph.degrees(e).collect()} == {"A": None, "B": 0, "C": 1, "D": None}
    weighted = e.withColumn("n", F.lit(1))
    assert rows(graph.top_edges(weighted, 1)) == [("A", "B", 1), ("B", "C", 1), ("C", "D", 1)]


def test_time_parts(spark):
    df = spark.createDataFrame([(dt.datetime(2020, 1, 1, 2), dt.datetime(2020, 1, 3, 1))], "a timestamp_ntz, b timestamp_ntz")
    assert tuple(df.select(times.days_between(F.col("a"), F.col("b")), times.hour_part(F.col("a"), F.col("b"))).first()) == (1, 23)
    week = spark.createDataFrame([(dt.date(2021, 1, 1),), (dt.date(2018, 12, 31),)], "d date").select(F.weekofyear("d")).collect()
    assert [x[0] for x in week] == [53, 1]


def test_arrays(spark):
    df = spark.createDataFrame([([1.0, 2.0, 1.0], [2.0, 2.0, 0.0], 5, 50)], "p array<double>, q array<double>, a int, b int")
    p, q = F.col("p"), F.col("q")
    got = df.select(arrays.cosine(p, q), arrays.distance(p, q), arrays.mean_place(p), arrays.central_moment(p, F.lit(2.0), 2), arrays.circular_lag(F.col("a"), F.col("b"), 52), arrays.blended(p, q, 4)).first()
    assert [round(x, 6) for x in got[:4]] == [round(6 / (48**0.5), 6), round(2**0.5, 6), 2.0, 0.5] and got[4] == 7
    assert [round(x, 6) for x in got[5]] == [0.375, 0.5, 0.125]


def test_dense_and_lookup(spark):
    df = spark.createDataFrame([("a", 2, 5)], "k string, w int, n long")
    assert rows(joins.dense(df, ["k"], "w", 1, 3, ["n"])) == [("a", 1, 0), ("a", 2, 5), ("a", 3, 0)]


def test_folds_have_even_sizes_and_a_gap(spark):
    df = spark.createDataFrame([(k, DAY + dt.timedelta(days=k // 2)) for k in range(23)], "id long, t timestamp_ntz")
    got = evaluation.expanding_folds(df, "t", "id", 5, 2).collect()
    assert [sum(x.fold == k and x.role == "val" for x in got) for k in range(1, 6)] == [4, 4, 4, 4, 3]
    for k in range(1, 6):
        val = min(x.id for x in got if x.fold == k and x.role == "val")
        train = [x.id for x in got if x.fold == k and x.role == "train"]
        assert all(x // 2 < val // 2 - 2 for x in train)


def test_ranking_metrics_equal_plain_python(spark):
    rng = random.Random(4)
    data = [(k, round(rng.random(), 1), int(rng.random() < 0.4)) for k in range(50)]
    df = spark.createDataFrame(data, "id long, s double, y int")
    order = sorted(data, key=lambda d: (-d[1], d[0]))
    total = sum(d[2] for d in data)
    for x in evaluation.curve_at(df, [0.05, 0.5, 1.0], "s", "y", "id").collect():
        hits = sum(d[2] for d in order[: x.n_reviewed])
        assert (x.recall, x.precision) == (hits / total, hits / x.n_reviewed)
    want, seen, hit = 0.0, 0, 0
    for s in sorted({d[1] for d in data}, reverse=True):
        g = [d for d in data if d[1] == s]
        seen, hit = seen + len(g), hit + sum(d[2] for d in g)
        want += sum(d[2] for d in g) / total * hit / seen
    assert abs(evaluation.average_precision(df, "s", "y").first()[0] - want) < 1e-12


def test_split_is_disjoint_and_bounded(spark):
    df = spark.createDataFrame([(k, DAY + dt.timedelta(days=k // 3)) for k in range(90)], "id long, t timestamp_ntz")
    got = evaluation.temporal_split(df, "t", "id", "2024-01-06", ("2024-01-08", "2024-01-20"), "2024-01-25", 7, None).collect()
    assert len({x.id for x in got}) == len(got) and statistics.mode(x.split for x in got)
    assert {s: sum(x.split == s for x in got) for s in ("train", "val", "test")} == {"train": 15, "val": 7, "test": 18}


def test_labels_need_the_submitted_node_if_there_is_one(spark):
    data = [(1, "a", True), (2, "b", True), (3, None, True), (4, "a", False), (5, None, True), (6, "a", True)]
    items = spark.createDataFrame([(i, DAY, n, ok) for i, n, ok in data], "item long, created timestamp_ntz, submitted string, ok boolean")
    agreed = spark.createDataFrame([(i, "a", 10, DAY + dt.timedelta(days=2)) for i in (1, 2, 4, 5)], "item long, node string, level int, decided timestamp_ntz")
    got = {r.item: (r.is_positive, r.days_to_positive) for r in consensus.label(items, agreed, "submitted", F.col("ok")).collect()}
    assert got == {1: (True, 2), 2: (False, None), 3: (False, None), 4: (False, None), 5: (True, 2), 6: (False, None)}  # 5 submitted nothing


def test_priors_fall_back_level_by_level(spark):
    from tidemark.operators import shrink

    df = spark.createDataFrame([(20, 5, 9, 9, 900, 90), (19, 5, 50, 10, 900, 90), (19, 5, 49, 10, 500, 100), (19, 5, 49, 10, 499, 100), (0, 0, 0, 0, 0, 0)], "n2 int, k2 int, n3 int, k3 int, n4 int, k4 int")
    levels = [(F.col(f"k{k}"), F.col(f"n{k}"), least) for k, least in ((2, 20), (3, 50), (4, 500))]
    rate, source = shrink.prior_of(levels, F.lit(0.4))
    assert [tuple(r) for r in df.select(rate, source).collect()] == [(0.25, 1), (0.2, 2), (0.2, 3), (0.4, 4), (0.4, 4)]


def test_clustering_of_any_directed_graph(spark):
    import random

    rng = random.Random(1)
    for loops in (0, 4):
        edges = {(rng.randrange(14), rng.randrange(14)) for _ in range(70)}
        edges = {(a, b) for a, b in edges if a != b} | {(k, k) for k in range(loops)} | {(0, k) for k in range(14) if k}
        near = {}
        for a, b in edges:
            near.setdefault(a, set()).add(b)
        want = {a: (len(x) * (len(x) - 1), sum((b, c) in edges for b in x for c in x if b != c)) for a, x in near.items()}
        df = spark.createDataFrame([*edges, *list(edges)[:5]], "src long, dst long")
        assert {r.node: (r.pairs, r.connected) for r in graph.clustering(df).collect()} == want
        some = graph.two_hops(spark.createDataFrame(list(edges), "src long, dst long"), F.col("src") % 5 == 0).collect()
        assert sorted(map(tuple, some)) == sorted((a, b, d) for a, b in edges for c, d in edges if b == c and a != d and a % 5 == 0)


def test_keyed_running_totals_and_ranks(spark):
    from pyspark.sql import Window

    data = [(k, k % 3 if k % 7 else None, k // 4, (k * 37) % 11 if k % 5 else None) for k in range(120)]
    df = spark.createDataFrame(data, "id long, g long, t long, v long")
    w = Window.partitionBy("g").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = {r.id: (r.n, r.s) for r in df.select("id", F.count(F.lit(1)).over(w).alias("n"), F.coalesce(F.sum("v").over(w), F.lit(0)).alias("s")).collect()}
    for step in (1, 3, 100):
        got = W.running_totals(df, ["g"], ["t", "id"], {"n": F.lit(1), "s": F.col("v")}, F.floor(F.col("t") / step))
        assert {r.id: (r.n, r.s) for r in got.collect()} == want
    p = F.percent_rank().over(Window.partitionBy("g").orderBy(F.col("v").asc_nulls_last()))
    want = {r.id: round(r.p, 9) for r in df.select("id", p.alias("p")).collect()}
    assert {r.id: round(r.p, 9) for r in W.percent_rank(df, ["g"], "v", F.floor(F.col("v") / 3), "p").collect()} == want
    alone = spark.createDataFrame([(1, 1, 1, 5)], "id long, g long, t long, v long")
    assert W.percent_rank(alone, ["g"], "v", F.col("v"), "p").first().p == 0


def test_flatten_names_and_zones(spark):
    from tidemark.functions import structs, times

    df = spark.sql("SELECT 1 AS id, named_struct('id', 2, 'user', named_struct('id', 3, 'name', 'x'), 'tags', array(1)) AS payload, 4 AS name")
    assert structs.flattened(df).columns == ["id", "id_1", "id_2", "name", "tags", "name_1"] and tuple(structs.flattened(df).first()) == (1, 2, 3, "x", [1], 4)
    texts = ["2024-01-01 00:00:00 -0400", "2024-01-01 00:00:00 UTC", "2024-01-01", "no", None]
    got = spark.createDataFrame([(x,) for x in texts], "s string").select(F.unix_seconds(times.zoned(F.col("s")))).collect()
    assert [r[0] for r in got] == [1704081600, 1704067200, 1704067200, None, None]
