import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import lines as L
from tidemark.llm import queries


def brute(docs, run=L.RUN, words=L.WORDS):
    """docs: (id, text); the texts that stay, by the definition."""
    cut = [(i, t.split("\n")) for i, t in docs if t is not None]
    first, gone = {}, {}
    order = sorted(range(len(cut)), key=lambda k: cut[k][0])
    for k in order:
        i, x = cut[k]
        for n in (1, run):
            for a in range(len(x) - n + 1):
                w = (n, *x[a : a + n])
                if n == 1 and run > 1 and x[a].count(" ") + 1 < words:
                    continue
                if first.setdefault(w, (i, a)) != (i, a):
                    gone.setdefault(i, set()).update(range(a, a + n))
    return {i: None if t is None else "\n".join(c for k, c in enumerate(t.split("\n")) if k not in gone.get(i, ())) for i, t in docs}


def run(spark, docs, **kw):
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, runs string, line int")
    done = L.dedup(df, **kw)
    assert done.columns == ["doc_id", "text", "runs", "line", "removed_runs"]
    return {r.doc_id: r for r in done.collect()}


P = " ".join(f"w{k}" for k in range(30))


def test_cases(spark):
    docs = [
        (1, "a\nb\nc"), (2, "x\na\nb\ny"), (3, None), (4, ""), (5, ""), (6, P), (7, f"q\n{P}\nr"), (8, P), (9, "a\na\na\na"), (10, "a"), (11, "b\nc\nd\na\nb"),
        (12, "\n\n\n"), (13, "long\nline\n" * 5000),
    ]
    want = brute(docs)
    got = run(spark, docs)
    assert {i: r.text for i, r in got.items()} == want
    assert want[2] == "x\ny" and want[7] == "q\nr" and want[8] == "" and want[13] == "long\nline\n"
    assert [tuple(r) for r in got[2].removed_runs] == [(1, 3)] and got[3].removed_runs == []


def test_random(spark):
    for depth in (1, 2, 3, 5):
        docs = []

        @settings(max_examples=60, database=None, deadline=None, derandomize=True)
        @given(st.lists(st.sampled_from(["a", "b", "c d", "", "e f g h"]), max_size=12))
        def gather(x):
            docs.append((len(docs), "\n".join(x)))

        gather()
        got = {i: r.text for i, r in run(spark, docs, run=depth, words=4).items()}
        assert got == brute(docs, depth, 4), depth


def test_same_ids_and_empty_table(spark):
    df = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (1, "b\na\nb"), (None, "a\nb"), (None, "z")], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.text) for r in L.dedup(df).collect())
    assert got == [(False, ""), (False, ""), (False, "b"), (True, "a\nb"), (True, "z")]
    assert L.dedup(df.limit(0)).count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a\nb", 1, 2, 3), (2, "a\nb", 4, 5, 6)], "doc_id long, text string, _found_i long, __found_h long, name long")
    got = sorted(tuple(r)[:5] for r in L.dedup(df).collect())
    assert got == [(1, "a\nb", 1, 2, 3), (2, "", 4, 5, 6)]


def test_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = con.execute(queries.ORACLES["op3_line_dedup"]).fetchall()
    got = [tuple(r) for r in queries.op3_line_dedup(spark, sf).collect()]
    assert sorted(got) == sorted(want) and sum(r[2] for r in got) > 0


def test_plans_do_not_grow_with_depth_or_size(spark, monkeypatch):
    plans = {}

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return saved(df, name)

    saved = L.saved
    monkeypatch.setattr(L, "saved", seen)
    shuffles, docs = [], []
    for n in (4, 40):
        docs = [(k, "\n".join(f"line {m} of {n}" for m in range(n))) for k in range(3)]
        assert {i: r.text for i, r in run(spark, docs).items()} == brute(docs)
        shuffles.append(plans["line-runs"].count("Exchange"))
    assert shuffles[0] == shuffles[1] <= 4
    done = L.dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert "SortMergeJoin" in done._jdf.queryExecution().executedPlan().toString()
