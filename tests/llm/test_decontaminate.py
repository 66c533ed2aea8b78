import random

from tidemark.llm import decontaminate as D
from tidemark.llm import queries


def distance(item, text):
    """Smallest edit distance of item to any part of text, by the plain recursion."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item, 1):
        new = [k]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edited(text, n, rng):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("xyz")
        elif kind == 1:
            del text[at]
        else:
            text.insert(at, rng.choice("xyz"))
    return "".join(text)


def test_pieces_cover_the_item():
    for n in (0, 3, 7):
        assert "".join(p for _, p in D.pieces("abcdefghijklmnop", n)) == "abcdefghijklmnop" and len(D.pieces("abcdefghijklmnop", n)) == n + 1


def test_equal_to_the_plain_recursion(spark):
    rng = random.Random(5)
    words = ["the", "quick", "brown", "fox", "jumps", "over", "lazy", "dog", "and", "éa"]
    items = [" ".join(rng.choices(words, k=rng.randrange(5, 30))) for _ in range(12)] + ["dog a", "", " ", None]
    docs = [None, "", "no", items[0].upper(), items[1].replace(" ", "\n"), items[2] + " " + items[2], items[2] + " " + items[2]]
    docs += [" ".join(rng.choices(words, k=30)) + " " + edited(items[k % 12], rng.randrange(0, 14), rng) + " tail" for k in range(60)]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    want = {}
    for i, t in enumerate(docs):
        for k, x in enumerate(items):
            if t and x and x.strip() and (n := distance(D.normal(x), D.normal(t))) <= D.budget_of(x, D.RATE):
                want[i, k] = n
    for block in (D.BLOCK, 200):
        got = {(r.doc_id, r.item_id): r.distance for r in D.find(d, b, block=block).collect()}
        assert got == want
    assert len(want) > 30 and D.find(d.limit(0), b).count() == 0 and D.find(d, b.limit(0)).count() == 0


def test_items_with_several_texts_and_other_types(spark):
    docs = spark.createDataFrame([("a", "xx the quick brown fox jumps yy", 1), ("b", "x " * 200_000 + "lazy dogs", 2), (None, "LAZY DOGS", 3)], "doc_id string, text string, item_id int")
    bench = spark.createDataFrame([(1.5, "the quick brown fox jumped", "a"), (1.5, "the quick brown fox jumps", "b"), (2.5, "lazy dogs", None)], "item_id double, text string, distance string")
    got = sorted(map(tuple, D.find(docs, bench).collect()), key=str)
    assert got == sorted([("a", 1.5, 0, 28), ("b", 2.5, 0, 400_009), (None, 2.5, 0, 9)], key=str)


def test_rows_without_items_are_kept_each_by_its_text(spark):
    long = "word " * 300_000
    rows = [(1, "a quick brown fox", "x"), (1, "see: the QUICK brown foxes jumped over", "y"), (None, "lazy dogs", None), (None, "clean", "z"), (2, None, "n"), (3, "", "e")]
    rows += [(4, long + "the quick brown foxes jump over", "l"), (5, long, "m"), (5, long, "m")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(1, "the quick brown foxes jumped over"), (2, "lazy dogs"), (3, " "), (None, "nothing of the kind")], "item_id long, text string")
    for block in (D.BLOCK, 10):
        got = D.without(docs, bench, block=block)
        assert got.schema == docs.schema
        assert sorted((r.item_id for r in got.collect())) == ["e", "m", "m", "n", "x", "z"]
    assert D.without(docs, bench.limit(0)).count() == len(rows) and D.without(docs.limit(0), bench).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    rows = queries.op10_decontamination(spark, sf).collect()
    exact = {(d, i) for d, t in docs.items() for i, x in items.items() if x in t}
    assert exact and exact <= {(r.doc_id, r.item_id) for r in rows}
    for r in rows:
        at = D.normal(docs[r.doc_id])[: r.end]
        item = D.normal(items[r.item_id])
        assert distance(item, at[-len(item) - 20 :]) == r.distance
