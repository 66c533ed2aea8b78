import hashlib
import importlib.util
from pathlib import Path

import public_tokenizers
import tiktoken

from tests.llm.test_decontaminate import distance
from tests.llm.test_jaccard import brute as similar
from tests.llm.test_lines import brute as without_repeats
from tidemark.llm import bpe, decontaminate, language, queries

_SPEC = importlib.util.spec_from_file_location("corpus_pipeline", Path(__file__).resolve().parents[2] / "corpus_pipeline.py")
P = importlib.util.module_from_spec(_SPEC)
_SPEC.loader.exec_module(P)


def test_stages_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language.fit(docs.where(queries.remainder(3) != 1))
    kept = {r.doc_id: r.text for r in language.predict(docs, model, known="good").where("lang_pred != 'und' AND score >= 0.3 AND good").collect()}
    cut = without_repeats(sorted(kept.items()))
    cut = {i: t for i, t in cut.items() if t == kept[i] or t.strip()}
    one = {i: cut[i] for i, _, c in similar(sorted(cut.items())) if i == c}
    items = [decontaminate.normal(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    # the plain recursion is slow, so exact copies are settled first and far texts aren't tried
    words = [set(x.split()) for x in items]
    clean = {}
    for i, t in one.items():
        low = decontaminate.normal(t)
        have = set(low.split())
        near = (x in low or (len(w & have) >= 0.5 * len(w) and distance(x, low) <= decontaminate.budget_of(x, decontaminate.RATE)) for x, w in zip(items, words, strict=True))
        if not any(near):
            clean[i] = t
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(str(public_tokenizers.path(queries.VOCABULARY))), special_tokens={})
    want = {}
    for i, t in clean.items():
        ids = known.encode_ordinary(t)
        want[i] = (len(ids), hashlib.sha256(b"".join(k.to_bytes(4, "little") for k in ids)).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    got = {r[0]: tuple(r[1:]) for r in P.run(spark, sf).collect()}
    assert got == want
    assert len(want) < len(one) < len(cut) < len(kept) + 1


def test_stages_with_odd_rows(spark, sf):
    rows = [(1, None, "en", "s", 0), (2, "", None, "s", 0), (None, "the house and the cat", "en", None, 21), (7, "the house and the cat", "en", "s", 21), (9, "the house and the cat", "en", "s", 21)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    item = spark.read.parquet(f"{sf}/benchmark.parquet").where("length(text) > 40").orderBy("item_id").first().text
    two = spark.createDataFrame([(None, item, "en", "s", 0), (5, item, "en", "s", 0), (5, "the house and the cat", "en", "s", 21)], docs.schema)
    assert [r.text for r in P.remove_benchmark(spark, two, sf).collect()] == ["the house and the cat"]
    for start in (docs, docs.limit(0)):
        df = start
        for name, stage in P.STAGES[:-1]:
            df = P.saved(stage(spark, df, sf), name)
            assert df.columns == docs.columns
        left = [(r.doc_id, r.text) for r in P.STAGES[-1][1](spark, df, sf).join(df, "doc_id").collect()]
        assert left == ([(7, "the house and the cat")] if start is docs else [])
        assert df.count() == (2 if start is docs else 0)


def test_near_copies_by_five_words_go(spark, sf):
    words = [f"w{k}" for k in range(100)]
    near = [*words]
    near[30], near[60] = "other", "another"
    have = [{tuple(w[k : k + 5]) for k in range(96)} for w in (words, near)]
    four = [{tuple(w[k : k + 4]) for k in range(97)} for w in (words, near)]
    share = lambda a, b: len(a & b) / len(a | b)
    assert share(*have) >= 0.8 and share(*four) < 0.85
    far = [f"v{k}" for k in range(100)]
    rows = [(i, " ".join(w), "en", "s", len(" ".join(w))) for i, w in ((1, words), (2, near), (3, far))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in P.join_similar(spark, docs, sf).collect()) == [1, 3]


def test_texts_of_no_learned_language_go(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    foreign = "kaksi suomalaista lähti metsään katsomaan miten karhut nukkuvat talven yli pesässään " * 4
    more = spark.createDataFrame([(-1, foreign, None, "s", len(foreign))], docs.schema)
    left = {r.doc_id for r in P.identify_language(spark, docs.unionByName(more), sf).select("doc_id").collect()}
    assert -1 not in left and len(left) >= 0.95 * docs.count()
