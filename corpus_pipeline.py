"""A training corpus from raw documents in five stages; each reads what the one before it has written.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of `documents` but for the last, which
returns the tokens' counts and digests. Rows without an id are never dropped as copies; for a benchmark item
each row goes or stays by its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard, language, lines, queries
from tidemark.llm.shared import dropped, saved, sifted

#: A text whose best language is less likely than this has none that was learned, nor has one of many words that hardly any learned text has.
LEAST_SCORE = 0.3
#: Words of a shingle, and the percentage of shared ones from which texts are copies.
SHINGLE, SIMILAR = 5, 80


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have words in a language learned from the labelled ones."""
    model = language.fit(docs.where(queries.remainder(3) != 1))
    found = language.predict(docs, model, label="_lang", score="_score", known="_known")
    return found.where((F.col("_lang") != "und") & (F.col("_score") >= LEAST_SCORE) & F.col("_known")).select(docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes repeated runs of lines; documents of which nothing but white space is left go."""
    done = lines.dedup(docs, out="_runs")
    left = done.where((F.size("_runs") == 0) | F.col("text").rlike(r"\S"))
    count = F.when(F.size("_runs") == 0, F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType))
    return left.withColumn("n_chars", count).select(docs.columns)


def join_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of similar ones."""
    copies = jaccard.find(docs, shingle=SHINGLE, percent=SIMILAR).where("doc_id != component_id").select("doc_id")
    told = sifted(docs, copies, "doc_id")  # most texts needn't be dealt out to learn that they stay
    left = told.where("_maybe").join(copies, "doc_id", "left_anti")
    return told.where("NOT _maybe").unionByName(left).select(docs.columns)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.without(docs, queries.table(spark, sf_dir, "benchmark"))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Counts and digests of the tokens, and of the bytes that they decode to."""
    return queries.token_digests(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard", join_similar),
    ("decontamination", remove_benchmark),
    ("byte_bpe", tokenize),
]

#: SQL can't express the language model.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(before)
        before = docs
    return docs
