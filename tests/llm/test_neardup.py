import numpy as np
import pytest

from tidemark.llm import neardup as N
from tidemark.llm import queries
from tidemark.llm.shared import components

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def unit_of(v):
    if not v or any(c is None or not np.isfinite(c) for c in v) or not any(v):
        return None
    v = np.array(v, np.float64) / max(abs(c) for c in v)
    return v / np.linalg.norm(v)


def brute(rows, cosine=0.93):
    ids, links = [r[0] for r in rows], {}
    unit = [unit_of(v) for _, v, _ in rows]
    good = [k for k, (i, _, c) in enumerate(rows) if unit[k] is not None and c is not None and i is not None]
    near = {k: [j for j in good if j != k and rows[j][2] == rows[k][2] and len(unit[j]) == len(unit[k]) and unit[j] @ unit[k] >= cosine] for k in good}
    for k in range(len(rows)):
        seen, todo = {k}, [k]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        links[k] = (ids[k], len(near.get(k, ())), ids[k] if ids[k] is None else min(ids[j] for j in seen))
    return sorted(links.values(), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = N.find(df, **kw).collect()
    assert all(r.kept == (r.vec_id == r.component_id or r.vec_id is None) for r in got)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=str)


def clustered(n, seed=1, d=16):
    rng = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        base = rows[rng.integers(len(rows))][1] if rows and rng.random() < 0.4 else rng.normal(size=d).tolist()
        v = np.array(base) + rng.normal(size=d) * 0.05 * np.linalg.norm(base) / 4
        rows.append((k, v.astype(np.float32).tolist(), int(rng.integers(2))))
    return rows


def test_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [], 1), (6, [0.0, 0.0], 1), (7, [1.0, None], 1), (8, [float("nan"), 1.0], 1),
        (9, [1.0, 0.0, 0.0], 1), (10, [1.0, 0.1], 1), (11, [1.0, 0.0], 2), (None, [1.0, 0.0], 1), (12, [1.0, 0.0], 1), (13, [3e38, 3e38], 1), (14, [1e-38, 1e-38], 1),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [r for r in rows if r[0] in (3, 4)]) == [(3, 0, 3), (4, 0, 4)]
    assert run(spark, rows[:0] or [(1, None, None)]) == [(1, 0, 1)]
    assert N.find(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("block, visitors, cell", [(1024, 4096, 256), (8, 16, 32)])
def test_blocks_count_each_link_once(spark, monkeypatch, block, visitors, cell):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "VISITORS", visitors)
    monkeypatch.setattr(N, "CELL", cell)
    rows = clustered(300)
    rows += [(1000 + k, *rows[k][1:]) for k in range(0, 60, 3)]
    assert run(spark, rows, recall=1.0) == brute(rows)


def test_traversal_equals_a_full_sort():
    rng = np.random.default_rng(2)
    d1, d2 = rng.random((20, 7)), rng.random((20, 5))
    for visits in (1, 4, 12, 35):
        got = N.traverse(d1, d2, visits)
        want = np.argsort((d1[:, :, None] + d2[:, None, :]).reshape(20, -1), 1, kind="stable")[:, :visits]
        assert (got == want).all()


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (160, 2))] + [(k, k + 1) for k in range(1000, 1080)] + [(2000, 2001 + k) for k in range(50)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def planted(n, pairs, seed, d=64, spread=None):
    """n vectors of one label, uniform or around `spread` centres, and copies of some at cosines of 0.932 to 0.937."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    if spread:
        x = rng.normal(size=(spread, d))[rng.integers(spread, size=n)] + 0.8 * x
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    base = x[rng.choice(n, pairs, replace=False)]
    noise = rng.normal(size=base.shape)
    noise -= (noise * base).sum(1, keepdims=True) * base
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = rng.uniform(0.932, 0.937, (pairs, 1))
    x = np.concatenate([x, cosine * base + np.sqrt(1 - cosine**2) * noise])
    return [(k, v.astype(np.float32).tolist(), 1) for k, v in enumerate(x)]


@pytest.mark.parametrize("spread, cell", [(None, 256), (40, 256), (None, 24)])
def test_recall_at_the_threshold(spark, monkeypatch, spread, cell):
    """25 or 256 cells with the default recall; at least 0.9 of the links at the threshold itself, none below it."""
    monkeypatch.setattr(N, "CELL", cell)
    rows = planted(5500, 500, 5, spread=spread)
    x = np.array([r[1] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(x[k : k + 500] @ x.T >= 0.93).sum(1) - 1 for k in range(0, len(x), 500)])
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    got = {r.vec_id: r.n_links for r in N.find(df).collect()}
    total = want.sum()
    print("recall", spread, cell, sum(got.values()) / total)
    assert total >= 1000 and all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.9 * total


def test_doubles_and_clashing_columns(spark):
    rows = [(1, [1.0, 1e-9], 1, "a", 1, 2, 3), (2, [1.0, 2e-9], 1, "b", 4, 5, 6), (3, [1.0, 1e-9], 1, "a", 1, 2, 3), (4, [1e300, 1e300], 1, "a", 1, 2, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, key string, id int, vec int, cell int")
    assert sorted(tuple(r) for r in N.find(df).collect()) == [(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True)]


def test_query(spark):
    """The fixtures have no links; that of planted ones is above."""
    sf = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = {i: (n, c) for i, n, c in brute(rows)}
    assert {r.vec_id: (r.n_links, r.component_id) for r in queries.op1_embedding_neardup(spark, sf).collect()} == want
