import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tidemark.llm import alignment, bpe, queries

A, B = (str(public_tokenizers.path(n)) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def both():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    return t, sentencepiece.SentencePieceProcessor(model_file=B)


def ends(sizes):
    out, at = [], 0
    for n in sizes:
        at += n
        out.append(at)
    return out


def brute(both, docs):
    """docs: (id, text); the query's rows by whole texts and the public libraries."""
    t, sp = both
    byte = {c: b for b, c in enumerate(bpe.byte_characters())}
    per = []
    for _, text in docs:
        if not text:
            per.append(None)
            continue
        e = t.encode(" " + text, add_special_tokens=False)
        one = [(i, bytes(byte[c] for c in s)) for i, s in zip(e.ids, e.tokens, strict=True)]
        two = [(i, bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()) for i in sp.encode(text)]
        want = (" " + text).encode()
        if b"".join(x for _, x in one) != want or b"".join(x for _, x in two) != want:
            per.append(None)
            continue
        ea, eb = ends(len(x) for _, x in one), ends(len(x) for _, x in two)
        common = sorted(set(ea) & set(eb))
        groups, links = [], []
        for low, high in zip([0, *common], common, strict=False):
            groups.append("|".join(",".join(str(i) for (i, _), e in zip(x, y, strict=True) if low < e <= high) for x, y in ((one, ea), (two, eb))))
        k = 0
        for (i, x), e in zip(one, ea, strict=True):
            while eb[k] <= e - len(x):
                k += 1
            m = k
            while m < len(eb) and (eb[m - 1] if m else 0) < e:
                links.append((i, two[m][0]))
                m += 1
        per.append((len(one), len(two), groups, links))
    count = Counter(p for x in per if x for p in set(x[3]))
    best = {}
    for (i, _), n in count.items():
        best[i] = max(best.get(i, 0), n)
    rows = []
    for (d, _), x in zip(docs, per, strict=True):
        if x is None:
            rows.append((d, 0, 0, 0, 0, "", 0, 0))
        else:
            rows.append((d, x[0], x[1], len(x[2]), len(x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest(), sum(count[p] == best[p[0]] for p in x[3]), sum(count[p] for p in x[3])))
    return sorted(rows, key=str)


TEXTS = [
    None, "", " ", "a", "  two  spaces\n\n\tand don't we'll 12345 ½ ² ", "a\n \nb \n c d  e​ f\x85 g\x1c h", "\x00\x01‍👩‍👩‍👧 ñandú Straße ÉTÉ 漢字かな 한글", "has ▁ in it", "▁",
    "x" * 5000, "ab" * 3000 + " " + "!" * 999, "word " * 3000, "word " * 3000, "<|endoftext|> <s> </s> <unk> <0x41>", "é ́combining ﬁ", "\r\n \r\n\t x", "漢字" * 3000, "a  ", "ends\n",
]


def run(spark, docs):
    df = spark.createDataFrame([(i, t, 1, "q") for i, t in docs], "doc_id long, text string, batch int, groups string")
    counts = ["n_a", "n_b", "n_groups", "n_links"]
    from pyspark.sql import functions as F

    from tidemark.llm.shared import saved

    done = saved(alignment.align(df, A, B, public_tokenizers.PATTERN).withColumn("groups", F.coalesce(F.sha2("groups", 256), F.lit(""))), "test")
    return sorted((tuple(r) for r in alignment.scored(done, ["doc_id", *counts, "groups"]).collect()), key=str)


@pytest.mark.parametrize("batch, broadcast", [(16 << 20, 4_000_000), (2000, 0)])
def test_equal_to_the_public_libraries_and_brute_force(spark, monkeypatch, both, batch, broadcast):
    monkeypatch.setattr(alignment, "BATCH", batch)
    monkeypatch.setattr(alignment, "BROADCAST", broadcast)
    rng = random.Random(2)
    docs = list(enumerate(TEXTS))
    docs += [(100 + k, "".join(rng.choices(["a", " ", "the", "é", "\n", "\t", " new", "Ω", "1", "'s", "."], k=60))) for k in range(60)]
    docs += [(None, "no id"), (100, docs[-1][1]), (100, docs[-1][1])]
    assert run(spark, docs) == brute(both, docs)


def test_empty_table(spark):
    assert run(spark, []) == []


def test_query(spark, sf, both):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.op12_token_alignment(spark, sf).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(both, docs)


def test_parts_are_cut_where_a_space_follows_a_visible_character():
    import pyarrow as pa
    import regex

    texts = [*(t for t in TEXTS if t), "é ​ x  y　 z\U0001f469 \U000e0001 q́ \x7f \xad ñ  ", "힣 ￿ a", "  "]
    found, n = alignment.cut(pa.array(texts))
    want = [regex.split(r"(?<=[^\s\p{Z}\p{C}])(?= )", " " + t, flags=regex.V0) for t in texts]
    assert n.tolist() == [len(x) for x in want]
    assert found.to_pylist() == [p for x in want for p in x]


def test_one_row_for_a_batch_and_one_shape_for_many_parts(spark):
    """A row for each distinct part, as it was, took more disk than four times the input."""
    rng = random.Random(3)
    docs = [(i, " ".join("".join(rng.choices("aeiourstn", k=6)) for _ in range(200))) for i in range(50)]
    df = spark.createDataFrame(docs, "id long, text string").coalesce(1)
    (row,) = alignment.tokenized(df, bpe.share(spark, A), bpe.share(spark, B), public_tokenizers.PATTERN).collect()
    assert sorted(row["ids"]) == list(range(50))
    parts = {w for _, t in docs for w in t.split(" ")}
    assert len(alignment._got(bytes(row["places"]))) == 50 * 200
    assert len(alignment._got(bytes(row["shapes"]))) == len(parts) > 5 * len(row["asked"])


def test_batch_in_which_no_part_is_spelled(spark, both):
    docs = [(1, "▁"), (2, "▁▁")]
    assert run(spark, docs) == brute(both, docs)


def test_numbers_are_given_back():
    import numpy as np

    for x in ([], [0], [-1, 5, 1 << 30, 70_000]):
        assert alignment._got(alignment._put(np.array(x, np.int64))).tolist() == x
