import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import blocks, graph


def test_common_and_reached_nodes_of_several_ranges(spark):
    """Equal to plain Python and to the triangles, with ids below zero, far apart and at the ends of a range, and a hub."""
    rng = random.Random(5)
    ids = [-blocks.SIDE - 1, -1, 0, 1, blocks.SIDE - 1, blocks.SIDE, 2**40, *range(100, 130), *range(3 * blocks.SIDE, 3 * blocks.SIDE + 30)]
    near = {x: set() for x in ids}
    for a, b in [(rng.choice(ids), rng.choice(ids)) for _ in range(300)] + [(0, x) for x in ids]:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    e = spark.createDataFrame([(a, b) for a, x in near.items() for b in x], "src long, dst long")
    want = {a: len({d for v in near[a] for d in near[v]} - {a}) for a in ids}
    assert {r.node: r.size for r in blocks.reached(e, 400_000).collect()} == {a: n for a, n in want.items() if n}
    closed = {r.node: r.connected for r in graph.clustering(e).where("connected > 0").collect()}
    assert closed == {r.node: r.connected for r in blocks.connected(e, 400_000).collect()} and len(closed) > 20
    assert closed == {a: n for a in ids if (n := sum(c in near[b] for b in near[a] for c in near[a]))}


def test_every_node_has_two_hops_and_no_pair_is_a_row(spark, sf):
    import __spark_entry__ as entry

    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    df = entry.queries()["two_hop_stats"](spark, sf)
    assert df.where(F.col("node") % 100 != 0).count() > 0 and df.count() == lines.select("l_partkey").distinct().count()
    plan = entry.queries()["clustering_coefficient"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PythonMapInArrow" in plan or "MapInArrow" in plan


def spread(spark, rng, count=150, step=10_000):
    """(neighbours, edges) of nodes whose neighbours are spread over all ids; every seventh isn't to be told, so no edge leads to it."""
    near = {x * step: set() for x in range(count)}
    for _ in range(1500):
        a, b = rng.choice([*near]), rng.choice([*near])
        if a != b and (a % (7 * step) or b % (7 * step)):
            near[a].add(b)
            near[b].add(a)
    return near, spark.createDataFrame([(a, b) for a, x in near.items() for b in x], "src long, dst long")


def test_neighbours_spread_over_all_ids_are_few_rows(spark, monkeypatch):
    """In many small blocks the same is found, and what is shuffled there are packed parts, not rows for each two ranges of ids."""
    near, e = spread(spark, random.Random(3))
    rows, sent = [], blocks._sent
    monkeypatch.setattr(blocks, "_sent", lambda packed, tasks, count: rows.append(packed.select(F.sum(F.size(tasks))).first()[0]) or sent(packed, tasks, count))
    for held in (blocks.HELD, 300):
        monkeypatch.setattr(blocks, "HELD", held)
        got = {r.node: r.connected for r in blocks.connected(e, 3_000).collect()}
        assert got == {a: n for a in near if (n := sum(c in near[b] for b in near[a] for c in near[a]))}
        assert rows[-1] < 20 * e.count()


def test_large_lists_are_looked_at_piece_by_piece(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(blocks, "PATHS", 7)
    monkeypatch.setattr(blocks, "TOGETHER", 3)
    monkeypatch.setattr(blocks, "SIDE", 4)
    above = {a: sorted({b for b in range(a + 1, 40) if rng.random() < 0.4}) for a in range(40)}
    want = np.zeros(40, np.int64)
    for a in above:
        for b in above[a]:
            for c in above[a]:
                if c in above[b]:
                    want[[a, b, c]] += 2
    found = np.zeros(40, np.int64)
    held = [blocks._Lists(), blocks._Lists()]
    for b in (0, 1):
        mine = [a for a in above if a % 2 == b]
        held[b].add(np.array(mine) // 2, np.array([len(above[a]) for a in mine]), np.array([c for a in mine for c in above[a]]))
        held[b].end()
    for a in (0, 1):
        for b in (0, 1):
            blocks._closed(held[a], a, held[b], b, 2, np.zeros(12, bool), found)
    assert (found == want).all() and want.sum() > 100


def test_lists_come_back_from_their_packed_parts():
    lens, values = np.array([0, 3, 0, 1, 2, 0]), np.array([0, 5, 2**31 - 1, 7, 3, 300_000])
    a, b = blocks._unpacked(blocks._packed(lens, blocks._gaps(values, lens)))
    assert (a == lens).all() and (blocks._values(b, a) == values).all()
    signed = np.array([-3, -1, 0, 4])
    assert blocks._fold(signed).tolist() == [5, 1, 0, 8]


def test_ends_of_paths_in_many_small_blocks(spark, monkeypatch):
    """Nodes that no edge leads to are only passed through; no block has all ends of a node."""
    near, e = spread(spark, random.Random(6))
    monkeypatch.setattr(blocks, "HELD", 300)
    told = {a for a in near if a % 70_000}
    want = {a: len({c for b in near[a] for c in near[b] if c in told} - {a}) for a in told}
    assert {r.node: r.size for r in blocks.reached(e.where("dst % 70000 != 0"), 3_000).collect()} == {a: n for a, n in want.items() if n}


def test_paths_of_one_node_are_looked_at_piece_by_piece(monkeypatch):
    rng = random.Random(7)
    kind, brand = [[rng.randrange(-1, 4) for _ in range(30)] for _ in range(2)]
    near = [sorted(b for b in range(30) if b != a and rng.random() < 0.5) for a in range(30)]
    lens, values = np.array([len(x) for x in near]), np.array([b for x in near for b in x])
    for most in (5, 1 << 20):
        monkeypatch.setattr(blocks, "PATHS", most)
        task = blocks._Ends(True)
        task.add(blocks._fold(np.arange(30)), lens, blocks._gaps(values, lens), lens * 0, values[:0], np.arange(30), np.array(kind) + 1, np.array(brand) + 1)
        got = next(task.reached(np.arange(30), lens, blocks._gaps(values, lens), np.array(kind) + 1, np.array(brand) + 1, np.array([0]))).to_pydict()
        for a in range(30):
            ends = [c for b in near[a] for c in near[b]]
            same, alike = [kind[c] == kind[a] >= 0 for c in ends], [brand[c] == brand[a] >= 0 for c in ends]
            want = [len({*ends}), 0, len(near[a]), len(ends), sum(kind[c] >= 0 for c in ends), sum(same), sum(alike), sum(x and y for x, y in zip(same, alike, strict=True))]
            assert [got[c][a] for c in blocks.REACHED] == want
