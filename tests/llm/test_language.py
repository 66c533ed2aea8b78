import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import language as L
from tidemark.llm import queries, words

TEXTS = ["the cat and the dog are in the house with the old man", "der hund und die katze sind in dem haus mit dem mann"]


def tiny():
    return L.train(TEXTS * 20, ["en", "de"] * 20, rounds=4, batch=8)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(3)
    model = L.Model(["a", "b", "c"], None, None, None, rng.normal(size=3), rng.normal(size=(3, 3)))
    scores = rng.normal(size=(5, 3))
    p, pairs = L.posteriors(model, scores, np.array([0]), np.array([5]), pairs=True)
    want, moved, total = np.zeros((5, 3)), np.zeros((3, 3)), 0
    for path in itertools.product(range(3), repeat=5):
        w = np.exp(model.start[path[0]] + sum(scores[t, c] for t, c in enumerate(path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:], strict=False)))
        total += w
        for t, c in enumerate(path):
            want[t, c] += w
        for a, b in zip(path, path[1:], strict=False):
            moved[a, b] += w
    assert np.allclose(p, want / total)
    assert np.allclose(pairs, moved / total)


def test_sequences_of_many_lengths_are_kept_apart():
    rng = np.random.default_rng(4)
    model = L.Model(["a", "b"], None, None, None, rng.normal(size=2), rng.normal(size=(2, 2)))
    size = np.array([3, 0, 1, 7, 3])
    first = np.cumsum(size) - size
    scores = rng.normal(size=(size.sum(), 2))
    p = L.posteriors(model, scores, first, size)
    for a, n in zip(first, size, strict=True):
        if n:
            assert np.allclose(p[a : a + n], L.posteriors(model, scores[a : a + n], np.array([0]), np.array([n])))


def test_words_of_mixed_text_get_their_own_labels():
    got = dict((w, c) for w, c, _ in L.label_words(tiny(), "the old man und die katze"))
    assert got["the"] == "en" and got["katze"] == "de"
    assert L.label_words(tiny(), "") == []


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "der hund"), (5, "der hund"), (6, "— …"), (None, "the house " * 30000), (7, "É")]
    df = spark.createDataFrame([(i, t, 1.0, "x") for i, t in rows], "doc_id long, text string, score double, lang_pred string")
    got = {r.doc_id: r for r in L.predict(df, tiny()).collect()}
    assert len(got) == 8
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5, 6, None)] == ["und", "und", "und", "de", "de", "und", "en"]
    assert got[1].score == 0 and 0.5 < got[4].score <= 1 and got[4].score == got[5].score
    assert got[7].lang_pred in ("en", "de")
    assert L.predict(df.limit(0), tiny()).count() == 0


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a", None)], "doc_id long, text string, lang string")
    model = L.fit(docs)
    assert model is None
    assert L.predict(docs.select("doc_id", "text"), model).first().lang_pred == "und"


def test_clashing_columns(spark):
    docs = spark.createDataFrame([(k, TEXTS[k % 2], ["en", "de"][k % 2], 0, 0, 0) for k in range(40)], "doc_id long, text string, lang string, _i int, _l int, _t int")
    model = L.fit(docs)
    assert model.labels == ["de", "en"]
    assert L.predict(docs, model).where("lang_pred = lang").count() == 40


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    got = queries.op5_language_crf(spark, sf).join(truth, "doc_id").where("held_out")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97


def test_texts_of_no_learned_language_are_known_as_such(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = L.fit(docs.where(queries.remainder(3) != 1))
    foreign = "kaksi suomalaista lähti metsään katsomaan miten karhut nukkuvat talven yli pesässään " * 4
    mixed = foreign + docs.where("lang = 'en'").orderBy("doc_id").first().text
    rows = [(1, foreign), (2, mixed), (3, "kaksi suomalaista"), (4, None), (5, "12 !!"), (6, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.good for r in L.predict(df, model, known="good").collect()}
    assert got == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False}
    assert L.predict(docs.where("text IS NOT NULL"), model, known="good").where("NOT good AND lang_pred != 'und'").count() == 0
    assert [r.good for r in L.predict(df, None, known="good").collect()] == [False] * 6


def test_short_texts_of_no_learned_language(spark):
    """The same rule for texts of any length: the fewer words there are, the stranger they must be."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = L.fit(docs.where(queries.remainder(3) != 1))
    strange = ["kaksi suomalaista lähti metsään katsomaan miten karhut nukkuvat talven yli pesässään", "qwrt zxcv plmk " * 6, "qwrt zxcv plmk " * 40_000, "qwrt zxcv"]
    got = L.predict(spark.createDataFrame(list(enumerate(strange)), "k int, text string"), model, known="good").orderBy("k").collect()
    assert [r.good for r in got] == [False, False, False, True]
    shorter = docs.select(F.explode(F.transform(F.array(*map(F.lit, (1, 2, 4, 9, 15))), lambda n: F.array_join(F.slice(F.split("text", r"\s+"), 3, n), " "))).alias("text"))
    got = L.predict(shorter, model, known="good").where("lang_pred != 'und'").agg(F.avg((~F.col("good")).cast("int"))).first()[0]
    assert got < 2 * L.CHANCE


def test_chance_bounds_the_binomial_tail():
    model = L.Model(["a"], None, None, None, None, None, 0.6, np.bincount([50, 60, 60, 80]))
    for n in (1, 5, 18, 40):
        for have in range(n + 1):
            tail = np.mean([sum(math.comb(n, j) * s**j * (1 - s) ** (n - j) for j in range(have + 1)) for s in (0.505, 0.605, 0.605, 0.805)])
            got = float(L.chance(model, np.array([n]), np.array([have]))[0])
            assert tail - 1e-12 <= got <= 1 and (have or np.isclose(got, tail))
    n = np.array([0, 1, 6, 30, 30])
    assert L.familiar(model, n, np.array([0, 0, 0, 0, 10])).tolist() == [True, True, True, False, True]


def test_emissions_equal_plain_features():
    """Words, n-grams and scores of a text again, by strings and dictionaries."""
    model = tiny()
    rng = np.random.default_rng(8)
    model.grams = rng.normal(size=model.grams.shape).astype(np.float32)
    texts = ["The old MAN, und ÉTÉ", "", "x", "die-Katze katze 12 é×Ö", "hund"]
    data, at = words.utf8(pa.array(texts))
    low, begin, end, doc = L.cut(data, at)
    plain = [(k, w) for k, t in enumerate(texts) for w in re.findall(r"[a-zA-Z\x80-\U0010ffff]+", t)]
    plain = [(k, "".join(c.lower() if c != "×" else c for c in w).encode()) for k, w in plain]
    assert [(k, low[a:b].tobytes()) for k, a, b in zip(doc, begin, end, strict=True)] == plain
    slots = len(model.grams)

    def mixed(x):
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ x >> shift) * factor % 2**64
        return x

    want = np.zeros((len(plain), 2))
    for row, (_, w) in enumerate(plain):
        edged = b"\0" + w + b"\0"
        for stop in range(2, len(edged) + 1):
            for size in (2, 3, 4):
                # what begins left of the edge is the first slot's
                slot = mixed(int.from_bytes(edged[stop - size : stop], "big") + ((size - 1) << 40)) >> (65 - slots.bit_length()) if stop >= size else 0
                want[row] += model.grams[slot]
        tag = int(words.hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0])
        slot = tag >> (65 - len(model.tags).bit_length())
        if int(model.tags[slot]) == tag:
            want[row] += model.lexicon[slot]
    assert np.allclose(L.emissions(model, low, begin, end), want, atol=1e-3)


def test_drawn_texts_are_whole_and_bounded_in_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(L, "train", lambda texts, langs: seen.append(sorted(zip(langs, texts, strict=True))))
    monkeypatch.setattr(L, "BYTES", 3000)
    rows = [(k, f"some text {k} " * 10, "en") for k in range(100)] + [(k, f"long text {k} " * 9000, "en") for k in range(100, 103)]
    rows += [(200, "only one " * 50_000, "de"), (201, None, "de"), (202, "x", None), (None, "x", "fr")] + [(300, "repeated", "es"), (300, "other", "es")] * 40
    L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    got = seen[0]
    assert {t for _, t in got} <= {t for _, t, _ in rows}
    assert [x for x in got if x[0] != "en"] == [("de", "only one " * 50_000), ("es", "other")]
    english = [t for c, t in got if c == "en"]
    assert 10 < len(english) and sum(map(len, english)) <= 3000
