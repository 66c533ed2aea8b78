import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import pii, queries

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, x):
    d = re.sub("[^0-9]", "", x)
    if kind == "ip":
        return all(int(p) <= 255 for p in x.split("."))
    if kind == "card":
        total = sum(int(c) if k % 2 == 0 else (int(c) * 2 - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d)))
        return 16 <= len(d) <= 19 and total % 10 == 0
    return 8 <= len(d) <= 15 if kind == "phone" else True


def brute(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m[0])]


def run(spark, texts):
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, spans string")
    names = list(PATTERNS)
    return {r.doc_id: [f"{s.kind}:{s.start}:{s.end}" for s in r.spans if s.kind in names] for r in pii.find(df).collect()}


TEXTS = [
    None, "", "no data", "mail a.b@c.de now", "a@b.c+d@e.f", "a@b.c+d", "@@a@b.c.", "é😀 x@y.z 1.2.3.4", "1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "9" * 30 + ".1.2.3",
    "4111 1111 1111 1111 and 4111-1111-1111-1112", "4111111111111111" * 2, "+1 (555) 010-9999.", "+49 30 123456 +1", "+1" + " " * 500, "a." * 3000 + "a@b" + ".c" * 3000, "x@y.zz " * 800,
    "a@b.c", "tel +44 20 7946 0958, card 5500 0000 0000 0004",
]


def test_base_spans_equal_brute_force(spark):
    got = run(spark, TEXTS)
    for k, t in enumerate(TEXTS):
        assert got[k] == brute(t), t


def test_random_texts(spark):
    texts = []

    @settings(max_examples=300, database=None, deadline=None, derandomize=True)
    @given(st.text(alphabet="ab1290.@+- ()é\n%_", max_size=60))
    def gather(t):
        texts.append(t)

    gather()
    got = run(spark, texts)
    for k, t in enumerate(texts):
        assert got[k] == brute(t), repr(t)


def test_added_kinds_and_scores(spark):
    df = spark.createDataFrame([(1, "IBAN DE89370400440532013000 or DE89370400440532013001"), (2, "ssn 123-45-6789"), (3, "123-45-6789"), (4, "my card 4111111111111111"), (5, "4111111111111111")], "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.end, round(s.score, 2)) for s in r.spans] for r in pii.find(df).collect()}
    assert got[1] == [("iban", 5, 27, 1.0)] and got[2] == [("ssn", 4, 15, 0.5)] and got[3] == []
    assert got[4] == [("card", 8, 24, 0.9)] and got[5] == [("card", 0, 16, 0.7)]


def test_redaction(spark):
    df = spark.createDataFrame([(1, "to a@b.cd or 1.2.3.4, not 300.1.1.1"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r.text for r in pii.redact(df).collect()}
    assert got == {1: "to [email] or [ip], not 300.1.1.1", 2: None}


def test_query_on_the_smallest_tables(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op9_pii(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        want = brute(docs[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k) for x in want) for k in PATTERNS]
        assert set(want) <= set(r.spans.split(",")) | {""}
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).count() == 0
