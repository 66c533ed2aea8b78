import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import blocks, queries
from tidemark.llm import substrings as S


def brute(docs, length=100):
    """docs: (id, text), sorted; the removed spans of each."""
    seen, out = set(), []
    for _, t in docs:
        x = (t or "").encode()
        gone = np.zeros(len(x), bool)
        for k in range(len(x) - length + 1):
            w = x[k : k + length]
            if w in seen:
                gone[k : k + length] = True
            seen.add(w)
        edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(int), [0]])))
        out.append([tuple(map(int, e)) for e in edge.reshape(-1, 2)])
    return out


@settings(max_examples=200, deadline=None, derandomize=True, database=None)
@given(st.binary(max_size=80), st.sampled_from([3, 9, 20, 100]))
def test_suffix_array_of_any_bytes(x, depth):
    text = np.frombuffer(bytes(c % 4 for c in x) if len(x) % 2 else x, np.uint8)
    got = S.suffix_array(text, depth)
    raw = text.tobytes()
    assert sorted(got.tolist()) == list(range(len(raw)))
    assert [raw[k : k + depth] for k in got] == sorted(raw[k : k + depth] for k in range(len(raw)))


def test_pieces_cover_all_windows():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 3, n).astype(np.uint8) for n in (0, 99, 100, 101, 700, 5000)] + [np.zeros(3000, np.uint8)]
    at = np.append(0, np.cumsum([len(t) for t in texts]))
    begin, end, key = S.minimizers(np.concatenate(texts), at, 100)
    windows = sorted(k for a, b in zip(begin, end, strict=True) for k in range(a, b - 99))
    assert windows == [k for a, b in zip(at, at[1:], strict=False) for k in range(a, b - 99)]
    assert len(key) == len(begin)


def documents(rng, n):
    words = ["alpha", "be", "ça", "delta", "0", "zz"]
    shared = [" ".join(rng.choices(words, k=60)) for _ in range(6)]
    docs = []
    for _ in range(n):
        parts = [rng.choice(shared)[rng.randrange(60) :] if rng.random() < 0.5 else " ".join(str(rng.random()) for _ in range(rng.randrange(9))) for _ in range(rng.randrange(6))]
        docs.append("\n".join(parts))
    return docs


def run(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, spans string, batch int")
    rows = S.dedup(df, **kw).collect()
    return {(r.doc_id, r.n_bytes, tuple((s.begin, s.end) for s in r.spans), bytes(r.kept)) for r in rows}, len(rows)


def want(docs, length=100):
    out = set()
    for (i, t), spans in zip(docs, brute(docs, length), strict=True):
        x = (t or "").encode()
        keep = np.ones(len(x), bool)
        for a, b in spans:
            keep[a:b] = False
        out.add((i, len(x), tuple(spans), np.frombuffer(x, np.uint8)[keep].tobytes()))
    return out


@pytest.mark.parametrize("batch, length", [(6 << 20, 100), (3000, 100), (2000, 33)])
def test_equal_to_brute_force(spark, monkeypatch, batch, length):
    monkeypatch.setattr(blocks, "BATCH", batch)
    rng = random.Random(3)
    docs = list(enumerate(documents(rng, 60)))
    docs += [(100, None), (101, ""), (102, "a" * 3000), (103, "a" * 200 + "b"), (104, "\0" * 150), (105, "ab" * 400), (106, "ab" * 400), (107, docs[0][1]), (108, docs[0][1])]
    got, rows = run(spark, docs, length=length)
    assert rows == len(docs) and got == want(docs, length)


def test_many_pieces_of_a_minimizer(monkeypatch):
    monkeypatch.setattr(S, "MANY", 2)
    rng = random.Random(5)
    docs = [" ".join(str(rng.random()) for _ in range(3)) + "the passage that is shared by all of them " * 3 + str(rng.random()) * 2 for _ in range(40)]
    import pyarrow as pa

    def table(x, k):
        return pa.table({"i": pa.array([i for i, _ in x], pa.int64()), "text": pa.array([t for _, t in x]), "batch": pa.array([k] * len(x), pa.int32())})

    numbered = list(enumerate(docs))
    batches = [table(numbered[k::4], k) for k in range(4)]
    ones = pa.table({"i": pa.array(range(40), pa.int64()), "key": [hashlib.md5(t.encode()).hexdigest() for t in docs]})
    asked = pa.concat_tables([blocks.ask(k, np.concatenate([key for *_, key, _ in S._pieces(b, ones, 100)])) for k, b in enumerate(batches)])
    hashes, counts = asked.column("hash").to_numpy(), asked.column("count").to_numpy()
    total = {int(k): int(counts[hashes == k].sum()) for k in np.unique(hashes)}
    twice = {k: n for k, n in total.items() if n > 1}
    assert max(twice.values()) > 2 * S.MANY
    answer = pa.table({"i": pa.array([*range(40), *[None] * len(twice)], pa.int64()), "key": [*ones.column("key").to_pylist(), *[None] * len(twice)], "hash": pa.array([*[None] * 40, *twice], pa.int64()), "count": pa.array([*[None] * 40, *twice.values()], pa.int32())})
    sent = pa.concat_tables([S._sent(b, answer, 100) for b in batches])
    shares = {}
    for k, (f, p) in enumerate(zip(sent.column("f1").to_pylist(), sent.column("part").to_pylist(), strict=True)):
        shares.setdefault((f, p), []).append(k)
    found = pa.concat_tables([S._compared(sent.take(pa.array(rows)), 100) for rows in shares.values()])
    assert (found.column("kind").to_numpy() == S.WINDOW).any()
    found = found.sort_by([(c, "ascending") for c in ("f1", "f2", "i", "place")])
    spans = S._settled(found, blocks._begins(found, ["f1", "f2"]), 100)
    got = {}
    for k, b in enumerate(batches):
        mine = spans.filter(pa.array(spans.column("batch").to_numpy() == k))
        mine = pa.concat_tables([mine.append_column("key", pa.nulls(len(mine), pa.string())), pa.table({"batch": pa.nulls(40, pa.int32()), "i": ones.column("i"), "place": pa.nulls(40, pa.int64()), "size": pa.nulls(40, pa.int64()), "key": ones.column("key")})])
        for r in S._left(b, mine, 100).to_pylist():
            got[r["i"]] = [(s["begin"], s["end"]) for s in r["spans"]]
    assert [got[k] for k in range(len(docs))] == brute(numbered)


def test_shares_of_a_frequent_piece_in_spark(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BATCH", 20_000)
    rng = random.Random(6)
    docs = [(k, f"{rng.random()} " + "a passage that more documents share than one task compares, " * 3 + str(rng.random())) for k in range(3 * S.MANY)]
    got, rows = run(spark, docs)
    assert rows == len(docs) and got == want(docs)


def test_same_and_null_ids(spark):
    t = "x" * 50 + "yz" * 60
    docs = [(1, t), (1, t), (None, t), (None, t), (2, "q" + t)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_bytes, len(r.kept)) for r in S.dedup(df).collect())
    first = len(t) - sum(b - a for a, b in brute([(1, t)])[0])
    assert got == [("1", 170, 0), ("1", 170, first), ("2", 171, 1), ("None", 170, 170), ("None", 170, 170)]
    assert S.dedup(df.limit(0)).count() == 0


def test_query(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = {tuple(r) for r in queries.op2_suffix_array(spark, sf).collect()}
    assert got == {(i, n, sum(b - a for a, b in s), len(s), hashlib.sha256(k).hexdigest()) for i, n, s, k in want(docs)}
