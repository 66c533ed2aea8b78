import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import blocks, queries, words
from tidemark.llm import jaccard as J
from tidemark.llm.shared import sifted


def sets(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()}


def brute(docs, percent=85):
    have = {}
    for i, t in docs:
        if i is not None:
            have[i] = sets(t)
    ids, parent = sorted(have), {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    by_first = [i for i in ids if have[i]]
    for k, a in enumerate(by_first):
        for b in by_first[k + 1 :]:
            x, y = have[a], have[b]
            if 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return sorted(((i, len(sets(t)), i if i is None else root(i)) for i, t in docs), key=str)


def run(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in docs], "doc_id long, text string, batch string, n int")
    return sorted((tuple(r) for r in J.find(df, **kw).collect()), key=str)


def family(rng, n, size, vocabulary=400):
    """n texts that are edited copies of a few, and unrelated ones."""
    docs, words = [], [f"w{k}" for k in range(vocabulary)]
    for _ in range(n):
        if docs and rng.random() < 0.6:
            w = rng.choice(docs).split()
            for _ in range(rng.randrange(0, max(2, len(w) // 12))):
                w[rng.randrange(len(w))] = rng.choice(words)
            docs.append(" ".join(w))
        else:
            docs.append(" ".join(rng.choices(words, k=rng.randrange(1, size))))
    return docs


def test_sets_equal_the_definition():
    texts = ["a b c d e", "A B\tc\nd  e a b c d", None, "", "x y", "  \x0b ", "É é é É é", "a b c d"]
    flat, size = J.shingle_sets(*words.utf8(pa.array(texts)), 4)
    assert size.tolist() == [len(sets(t)) for t in texts]
    cut = np.append(0, np.cumsum(size))
    part = [set(flat[a:b].tolist()) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    for k, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len(part[k] & part[j]) == len(sets(a) & sets(b))


def test_similar_sets_share_a_piece():
    rng = np.random.default_rng(1)
    for n in [*range(1, 80), 127, 128, 250, 256, 300, 511, 700, 1030]:
        for _ in range(4):
            base = rng.integers(0, 2**63, n).astype(np.uint64)
            apart = int(J.most_apart(np.array([n]), 85)[0])
            drop = int(rng.integers(0, apart + 1))
            other = np.concatenate([base[min(drop, n - 1) :], rng.integers(0, 2**63, apart - drop).astype(np.uint64)])
            a, b = np.unique(base), np.unique(other)
            if J.similar(a, b, 85):
                h, of = J.pieces(np.concatenate([a, b]), np.array([len(a), len(b)]), 85)
                assert set(h[of == 0].tolist()) & set(h[of == 1].tolist()), n


def test_tree_keeps_what_plain_bounds_keep():
    rng = np.random.default_rng(2)
    counts = rng.poisson(rng.choice([2, 3, 8], (300, 1)), (300, 16))
    size = counts.sum(1)
    tree = J.Tree(counts, size, 85)
    for k in range(0, 300, 7):
        want = np.flatnonzero(185 * np.minimum(counts, counts[k]).sum(1) >= 85 * (size[k] + size))
        assert tree.near(k).tolist() == want.tolist()


@pytest.mark.parametrize("chunk, docs", [(512, 512), (3, 4)])
def test_components_equal_brute_force(spark, monkeypatch, chunk, docs):
    monkeypatch.setattr(J, "CHUNK", chunk)
    monkeypatch.setattr(J, "DOCS", docs)
    monkeypatch.setattr(blocks, "BATCH", 6000)
    rng = random.Random(7)
    texts = family(rng, 90, 60) + family(rng, 60, 300) + family(rng, 60, 8, 20)
    rows = list(enumerate(texts)) + [(1000, None), (1001, ""), (1002, "a b"), (1003, "A  b"), (None, "a b"), (1004, "z " * 50000), (1005, "z " * 50000), (1000, None)]
    got, want = run(spark, rows), brute(rows)
    assert got == want
    assert len({c for _, _, c in want}) < 180


def test_rows_of_one_id(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    docs = [(7, b), (7, a), (7, None), (9, a), (8, b), (9, a)]
    got = run(spark, docs)
    assert [r for r in got if r[0] == 7] == [(7, 0, 7), (7, 37, 7), (7, 37, 7)] and [r for r in got if r[0] == 9] == [(9, 37, 7)] * 2


@pytest.mark.parametrize("sign", [1, -1])
def test_links_of_texts_that_share_an_id(spark, sign):
    rng = random.Random(4)
    t1, t2, t3 = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(60)) for c in "xyz")
    near = lambda t: t.rsplit(" ", 1)[0] + " end"
    # a set that an ordinary id has too, one that only rows of the repeated id have, and one without partners
    docs = [(5, t1), (5, t2), (5, t3), (5, ""), (5, t2), (9, t2), (10, near(t2)), (11, near(t3)), (12, near(t2) + " more")]
    docs = [(sign * i, t) for i, t in docs]
    got = {(i, n): c for i, n, c in run(spark, docs)}
    least = 5 if sign > 0 else -12
    assert got[sign * 9, 57] == got[sign * 10, 57] == got[sign * 12, 58] == least
    assert got[sign * 11, 57] == min(sign * 5, sign * 11) and got[sign * 5, 0] == sign * 5


def test_empty_table(spark):
    assert J.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted(tuple(r) for r in queries.op8_ngram_jaccard(spark, sf).collect())
    assert got == sorted(brute(docs), key=lambda r: r[0])


def met(a, b, percent):
    """(whether two sets share a piece, whether the counts of a window with one allow a link)."""
    parts = []
    for value, of, flat, whole, size in J.windowed_pieces(np.concatenate([a, b]), np.array([len(a), len(b)]), percent):
        counts = J.count_vectors(flat, size, J.GROUPS)
        parts += [(v, whole[o], counts[o], size[o]) for v, o in zip(value.tolist(), of, strict=True)]
    first = {v: (c, n) for v, s, c, n in parts if s == 0}
    both = [(first[v], (c, n)) for v, s, c, n in parts if s == 1 and v in first]
    return bool(both), any((100 + percent) * np.minimum(x, y).sum() >= percent * (n + m) for (x, n), (y, m) in both)


@pytest.mark.parametrize("percent", [80, 85])
def test_windows_tell_long_sets_apart_and_miss_none(percent):
    rng = np.random.default_rng(5)
    draw = lambda n: rng.integers(0, 2**64, n, dtype=np.uint64)
    for n in (60, 700, 1023, 1024, 1100, 2047, 2600, 5000, 18_000):
        base = draw(n)
        apart = int(J.most_apart(np.array([n]), percent)[0])
        for drop in (0, apart // 2, apart):
            a, b = np.unique(base), np.unique(np.concatenate([base[drop:], draw(apart - drop)]))
            assert not J.similar(a, b, percent) or met(a, b, percent) == (True, True), (n, drop)
    for n in (5000, 18_000):  # a fifth in common, which counts of whole sets don't rule out
        common = draw(n // 5)
        a, b = (np.unique(np.concatenate([common, draw(n - len(common))])) for _ in range(2))
        whole = J.count_vectors(np.concatenate([a, b]), np.array([n, n]), J.GROUPS)
        assert (100 + percent) * np.minimum(*whole).sum() >= percent * 2 * n and not met(a, b, percent)[1], n


def test_long_texts_that_share_passages(spark):
    rng = random.Random(9)
    write = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage = write(300)
    texts = [" ".join(write(3000) + passage) for _ in range(4)]
    near = texts[0].split()
    for k in range(5, 2500, 100):
        near[k] = "other"
    rows = list(enumerate([*texts, " ".join(near), texts[1]]))
    got = run(spark, rows, percent=85)
    assert got == brute(rows) and [c for _, _, c in got] == [0, 1, 2, 3, 0, 1]


def test_sifted_rows_are_in_no_key(spark):
    keys = spark.range(0, 5000, 7).toDF("k")
    rows = spark.createDataFrame([(k, "x") for k in range(-50, 5000)] + [(None, "y"), (2**40, "z")], "k long, t string")
    got = {r.k: r._maybe for r in sifted(rows, keys, "k").collect()}
    assert all(got[k] for k in range(0, 5000, 7)) and sum(got.values()) < 5000 // 7 + 60
    assert not any(r._maybe for r in sifted(rows, keys.limit(0), "k").collect())
