import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import quality as Q
from tidemark.llm import queries, words


def test_word_hashes_depend_on_the_word_alone():
    texts = ["aa bb", None, "", "bb  cc aa", "x", "aa"]
    data, at = words.utf8(pa.array(texts))
    begin, end, text = words.spans(data != 32, at)
    found = [data[a:b].tobytes().decode() for a, b in zip(begin, end, strict=True)]
    assert found == ["aa", "bb", "bb", "cc", "aa", "x", "aa"] and text.tolist() == [0, 0, 3, 3, 3, 4, 5]
    h = words.hashes(data, begin, end)
    assert len(set(h.tolist())) == len(set(found)) and h[0] == h[4] == h[6]


def test_parts_hold_whole_texts():
    column = pa.array(["ab", "c" * 50, "", "d", None])
    got = [(k, bytes(d), a.tolist()) for k, d, a in words.parts(column, 4)]
    assert [k for k, _, _ in got] == [0, 1, 2] and b"".join(d for _, d, _ in got) == b"ab" + b"c" * 50 + b"d"
    assert sum(len(a) - 1 for _, _, a in got) == 5


def test_ftrl_equals_the_published_update():
    model = Q.Ftrl(alpha=0.5, beta=1, l1=0.1, l2=0.2, size=4)
    rows = [([0, 1], [1.0, 0.5], 1), ([1, 3], [0.3, 2.0], 0), ([0, 1, 3], [1.0, 1.0, 1.0], 1)]
    z, n = [0.0] * 4, [0.0] * 4
    for at, x, y in rows:
        w = {}
        for i in at:
            w[i] = 0.0 if abs(z[i]) <= 0.1 else -(z[i] - np.sign(z[i]) * 0.1) / ((1 + n[i] ** 0.5) / 0.5 + 0.2)
        p = 1 / (1 + np.exp(-sum(w[i] * v for i, v in zip(at, x, strict=True))))
        for i, v in zip(at, x, strict=True):
            g = (p - y) * v
            s = ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5
            z[i] += g - s * w[i]
            n[i] += g * g
        model.update(np.array(at), np.array(x), y)
    assert np.allclose(model.z, z) and np.allclose(model.n, n)


def test_scores_equal_plain_features(spark):
    """Features and scores again, text by text with lists and dictionaries."""
    texts = ["The quick, QUICK brown Fox!! 2024", None, "", "   ", "a", "x9 x9 x9 — é", "one two", "A" * 700 + " b"]
    mask = 2**64 - 1
    k = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)
    rng = np.random.default_rng(9)
    weights = rng.normal(size=1 << Q.BITS).astype(np.float32)

    def plain(text):
        raw = (text or "").encode()
        tokens = re.findall(rb"[0-9A-Za-z\x80-\xff]+|[!-/:-@\[-`{-~]+", raw)
        hashed = [int(words.hashes(np.frombuffer(t, np.uint8), np.array([0]), np.array([len(t)]))[0]) for t in tokens]
        shapes = []
        for n, t in enumerate(tokens):
            caps, digits = len(re.findall(rb"[A-Z]", t)), len(re.findall(rb"[0-9]", t))
            kind = 0 if re.match(rb"[!-/:-@\[-`{-~]", t) else min(caps, 2) + 1
            shapes.append(((kind * 3 + min(digits, 2)) * 8 + min(len(t).bit_length() - 1, 7)) * 2 + (n > 0 and t == tokens[n - 1]))
        got = list(hashed)
        got += [a * k[0] + b for a, b in zip(hashed, hashed[1:], strict=False)]
        got += [a * k[1] + b * k[2] + k[3] for a, b in zip(shapes, shapes[1:], strict=False)]
        got += [(a * k[1] + b) * k[2] + c * k[4] for a, b, c in zip(shapes, shapes[1:], shapes[2:], strict=False)]
        got.append(min((len(raw) + 1).bit_length() - 1, 20) * k[4] + k[1])
        slots = [int(words.mix(np.array([x & mask], np.uint64))[0]) >> (64 - Q.BITS) for x in got]
        return 1 / (1 + math.exp(-16 * sum(float(weights[x]) for x in slots) / len(slots)))

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = [r.score for r in Q.score(df, weights).orderBy("doc_id").collect()]
    assert np.allclose(got, [plain(t) for t in texts], atol=1e-5)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (4, "w " * 200000), (None, "!!")], "doc_id long, text string")
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (2, None), (9, 1)], "doc_id long, quality int")
    weights = Q.fit(docs, labels)
    got = Q.score(docs.withColumn("score", F.lit("old")), weights)
    assert got.columns == ["doc_id", "score"]
    rows = [r.score for r in got.orderBy("doc_id").collect()]
    assert len(rows) == 6 and all(0 <= x <= 1 for x in rows) and rows[1] == rows[2] and rows[3] == rows[4] > rows[5]
    none = Q.fit(docs, labels.limit(0))
    assert {r.score for r in Q.score(docs, none).collect()} == {0.5}
    assert Q.score(docs.limit(0), none).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op7_quality_ftrl(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.9
