import hashlib
import math
import random
import re

import xxhash
from pyspark.sql import functions as F

from tidemark.llm import fingerprints as P
from tidemark.llm import queries, shared

MASK = (1 << 64) - 1


def hashed(*values):
    """What xxhash64 gives for strings and for bigints, each seeded by the one before."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else (v & MASK).to_bytes(8, "little") if v.bit_length() > 31 else None
        seed = xxhash.xxh64(raw, seed=seed).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def with_int(t, f):
    """xxhash64 of a bigint and an int."""
    seed = xxhash.xxh64((t & MASK).to_bytes(8, "little"), seed=42).intdigest()
    return xxhash.xxh64(f.to_bytes(4, "little"), seed=seed).intdigest()


def of_list(x):
    seed = 42
    for t in x:
        seed = xxhash.xxh64((t & MASK).to_bytes(8, "little"), seed=seed).intdigest()
    return seed


def terms(text):
    return {hashed(w) for w in re.findall(r"[^\W_]+", (text or "").lower())}


def told(text, known):
    kept = sorted(terms(text) & known)
    if not kept:
        return f"-{hashed(text or '') & MASK:016x}"
    out = f"{of_list(kept):016x}"
    for f in range(1, P.FAMILIES + 1):
        left = kept
        for j in range(1, P.LEVELS + 1):
            left = [t for t in left if with_int(t, f) >> (64 - j) == 0]
            x = of_list(left)
            out += f"{(x - (1 << 64) if x >> 63 else x) % 65535 + 1:04x}" if left else "0000"
    return out


def like(a, b):
    if a == b:
        return 1.0
    if "-" in (a[0], b[0]):
        return 0.0
    cells = lambda x: [[x[16 + (f * P.LEVELS + j) * 4 :][:4] for f in range(P.FAMILIES)] for j in range(P.LEVELS)]
    pairs = list(zip(cells(a), cells(b), strict=True))
    used = [sum(x != "0000" or y != "0000" for x, y in zip(p, q, strict=True)) for p, q in pairs]
    same = [sum(x == y != "0000" for x, y in zip(p, q, strict=True)) for p, q in pairs]
    windows = range(P.LEVELS - P.NEAR + 1)
    return max(sum(same[k : k + P.NEAR]) / max(1, sum(used[k : k + P.NEAR])) for k in windows if k == 0 or sum(used[k : k + P.NEAR]) >= P.FAMILIES * P.NEAR / 2)


def brute(docs):
    """docs: (id, text); the rows of compare_edited."""
    n = len(docs)
    counts = {}
    for _, t in docs:
        for x in terms(t):
            counts[x] = counts.get(x, 0) + 1
    least, most = max(2, math.ceil(n / math.exp(P.BAND[1]) - 1e-9)), math.floor(n / 2 + 1e-9)
    known = {x for x, c in counts.items() if least <= c <= max(least, most)}
    order = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, hashed(d[1] or "")), reverse=True)
    out = []
    for k, (i, t) in enumerate(order):
        t, following = t or "", order[(k + 1) % n][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        a, b, c = told(t, known), told(edited, known), told(following, known)
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=str)


def texts(rng, n):
    words = ["".join(rng.choices("abcdéñ", k=rng.randrange(1, 5))) for _ in range(300)]
    return [" ".join(rng.choices(words, k=rng.randrange(0, 120))) for _ in range(n)]


def collected(df):
    return sorted(((r[0], r[1], r[2], r[3], r[4], round(r[5], 9), round(r[6], 9)) for r in df.collect()), key=str)


def test_equal_to_brute_force(spark, monkeypatch):
    monkeypatch.setattr(P, "BUCKET", 3000)
    rng = random.Random(3)
    docs = list(enumerate(texts(rng, 120)))
    docs += [(200, None), (201, ""), (202, "?! 漢字"), (203, docs[4][1]), (None, "null id " + docs[5][1]), (204, "once upon only" * 3), (205, "X y"), (7, docs[3][1]), (7, docs[3][1]), (-3, "a")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, fingerprint string, term int")
    assert collected(P.compare_edited(df)) == brute(docs)
    monkeypatch.setattr(P, "BROADCAST", 0)
    assert collected(P.compare_edited(df)) == brute(docs)
    assert P.compare_edited(df.limit(0)).count() == 0
    assert collected(P.compare_edited(df.limit(1)))[0][6] == 1.0


def test_fingerprints_keep_rows_and_columns(spark):
    rng = random.Random(4)
    some = texts(rng, 30)
    docs = [(k % 25, t, "old", k) for k, t in enumerate([*some, *some, None, None, ""])]
    df = spark.createDataFrame(docs, "doc_id long, text string, fingerprint string, x int")
    done = P.fingerprint(df)
    assert done.columns == ["doc_id", "text", "x", "fingerprint"] and done.count() == len(docs)
    by = {}
    for r in done.collect():
        by.setdefault(r.text or "", set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by.values())
    known = {r.term for r in P.lexicon(df).collect()}
    assert all(v == {told(t, known)} for t, v in by.items())


def test_ranges_are_even_and_in_order(spark):
    df = spark.createDataFrame([(k // 3 if k % 50 else None, k) for k in range(6000)], "a long, b long")
    got = df.withColumn("r", shared.ranges(df, ["a", "b"], 300)).orderBy(F.asc_nulls_first("a"), "b").collect()
    assert [r.r for r in got] == sorted(r.r for r in got)
    sizes = df.withColumn("r", shared.ranges(df, ["a", "b"], 300)).groupBy("r").count().collect()
    assert len(sizes) > 200 and max(r["count"] for r in sizes) < 100
    assert {r[0] for r in df.select(shared.ranges(df.limit(0), ["a"], 9)).distinct().collect()} == {0}


def test_query(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(queries.op13_imatch(spark, sf)) == brute(docs)
