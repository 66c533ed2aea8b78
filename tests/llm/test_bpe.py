import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from tidemark.llm import bpe, queries

PATH = str(public_tokenizers.path(queries.VOCABULARY))
TEXTS = [
    None,
    "",
    " ",
    "a",
    "  two  spaces\n\n\tand don't we'll 12345 ½ ²",
    "a\x1c\x1cb \x85c d e　▁f",
    "\x00\x01‍👩‍👩‍👧 ñandú Straße ÉTÉ 漢字かな 한글",
    "x" * 5000,
    "ab" * 3000 + " " + "!" * 999,
    "word " * 20000,
    "word " * 20000,
    "<|endoftext|>",
]


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_ids_equal_the_public_library_and_decode_to_the_text(spark, known):
    df = spark.createDataFrame([(k, t, "en", t) for k, t in enumerate(TEXTS)], "doc_id long, text string, ids string, decoded string")
    done = bpe.decode(bpe.encode(df, PATH, public_tokenizers.PATTERN), PATH, public_tokenizers.PATTERN)
    assert done.columns == ["doc_id", "ids", "decoded"]
    for row in done.withColumn("n", bpe.unpack()).collect():
        text = TEXTS[row.doc_id] or ""
        assert row.n == known.encode_ordinary(text)
        assert bytes(row.decoded) == text.encode()
    at_once = bpe.encode(df, PATH, public_tokenizers.PATTERN, decoded="decoded")
    assert at_once.columns == ["doc_id", "ids", "decoded"]
    assert sorted(at_once.collect()) == sorted(done.collect())


def test_digests(spark, sf, known):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op4_byte_bpe(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = known.encode_ordinary(docs[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_empty_table_and_forgetting(spark, monkeypatch):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(empty, PATH, public_tokenizers.PATTERN).count() == 0
    monkeypatch.setattr(bpe, "CACHE", 3)
    codec = bpe.Codec(bpe.read_ranks(PATH), public_tokenizers.PATTERN)
    got = [list(codec.encode_many([t])) for t in ("a b c", "d e f", "a b c")]
    assert got[0][0].tolist() == got[2][0].tolist()


def test_a_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        bpe.model_bytes({b"a": 0})


def test_query_columns(spark, sf):
    assert dict(queries.op4_byte_bpe(spark, sf).select(F.col("*")).dtypes) == {
        "doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"
    }
