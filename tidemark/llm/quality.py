"""Document quality by logistic regression on hashed word n-grams, fitted with follow-the-regularised-leader updates.

A token is a run of letters and digits or a run of other visible characters. Features are hashed: each token, each pair
of neighbours, each pair and triple of neighbours' shapes (case, digits, symbols, length, same as the token before),
and a class of the text's length. A text's vector holds each feature's share of the features; its score is a sparse dot product.

Defined results: a text that is null or has no token scores by its length class alone; without a labelled row every
score is 0.5; copies score alike; rows with a null id or null label teach nothing; other columns are not used.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import words

#: Labelled rows that the model is fitted on at most, taken by a hash of the id.
SAMPLE = 6000
BITS = 18


@dataclass
class Ftrl:
    """Weights by coordinate-wise follow-the-regularised-leader updates."""

    alpha: float = 0.3
    beta: float = 1.0
    l1: float = 0.0
    l2: float = 0.05
    size: int = 1 << BITS

    def __post_init__(self):
        self.z, self.n = np.zeros(self.size), np.zeros(self.size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1, 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        """One row: distinct features `at` with values x, and its label."""
        w = self.weights(at)
        g = (sigmoid(float(w @ x)) - y) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


_KIND = np.zeros(256, np.uint8)  # 0 space, 1 symbol, 2 letter or digit
_KIND[33:127] = 1
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = 2


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(feature, text, number of features of each text) of a part of a text column."""
    count = len(at) - 1
    kind = _KIND[data]
    begin = [words.spans(kind == k, at) for k in (1, 2)]
    begin, end, text = (np.concatenate(x) for x in zip(*begin, strict=True))
    order = np.argsort(begin, kind="stable")
    begin, end, text = begin[order], end[order], text[order]
    token = words.hashes(data, begin, end)
    upper = np.zeros(len(data) + 1, np.int64)
    upper[1:] = np.cumsum((data >= 65) & (data <= 90))
    digit = np.zeros(len(data) + 1, np.int64)
    digit[1:] = np.cumsum((data >= 48) & (data <= 57))
    size = end - begin
    caps, digits = upper[end] - upper[begin], digit[end] - digit[begin]
    shape = np.where(kind[begin] == 1, 0, np.where(caps == 0, 1, np.where(caps == 1, 2, 3))) if len(begin) else size
    shape = (shape * 3 + np.minimum(digits, 2)) * 8 + np.minimum(np.log2(np.maximum(size, 1)).astype(np.int64), 7)
    same = np.zeros(len(begin), bool)
    same[1:] = (token[1:] == token[:-1]) & (text[1:] == text[:-1])
    shape = (shape * 2 + same).astype(np.uint64)
    two, three = np.flatnonzero(text[1:] == text[:-1]) + 1, np.flatnonzero(text[2:] == text[:-2]) + 2
    k = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
    long = np.minimum(np.log2(np.diff(at) + 1), 20).astype(np.uint64)
    got = [
        (token, text),
        (token[two - 1] * k[0] + token[two], text[two]),
        (shape[two - 1] * k[1] + shape[two] * k[2] + k[3], text[two]),
        ((shape[three - 2] * k[1] + shape[three - 1]) * k[2] + shape[three] * k[4], text[three]),
        (long * k[4] + k[1], np.arange(count)),
    ]
    feature = words.mix(np.concatenate([x for x, _ in got])) >> np.uint64(64 - BITS)
    text = np.concatenate([t for _, t in got])
    return feature.astype(np.int64), text, np.bincount(text, minlength=count)


def labelled(docs: DataFrame, labels: DataFrame, id: str, text: str, label: str, rows: int) -> DataFrame:
    """At most `rows` labelled rows with whole texts: the ids with the smallest hash; the other side of the join has that bound."""
    chosen = labels.select(id, F.col(label).cast("double").alias("_y")).where(F.col(id).isNotNull() & F.col("_y").isNotNull())
    chosen = chosen.orderBy(F.xxhash64(id), "_y").limit(rows)
    return docs.select(id, F.col(text).alias("_text")).join(F.broadcast(chosen), id)


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", rows: int = SAMPLE, rounds: int = 3) -> np.ndarray:
    """The weights. Features are made on the executors; the driver gets at most `rows` sparse vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data, at in words.parts(batch.column("_text")):
                feature, doc, n = features(data, at)
                key, times = np.unique(doc << BITS | feature, return_counts=True)
                cut = np.searchsorted(key >> BITS, np.arange(len(at)))
                share = (times / n[key >> BITS]).astype(np.float32)
                index = (key & (1 << BITS) - 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column(id).slice(k, len(at) - 1), batch.column("_y").slice(k, len(at) - 1),
                    pa.ListArray.from_arrays(cut.astype(np.int32), index), pa.ListArray.from_arrays(cut.astype(np.int32), share),
                ], names=["id", "y", "at", "x"])

    got = labelled(docs, labels, id, text, label, rows).select(F.col(id).cast("string").alias(id), "_y", "_text")
    got = got.mapInArrow(words.trimmed(run), "id string, y double, at array<int>, x array<float>").toArrow().to_pydict()
    order = np.random.default_rng(7).permutation(np.argsort(np.array(got["id"], dtype=object), kind="stable")) if got["id"] else []
    model = Ftrl()
    for _ in range(rounds):
        for k in order:
            # the values are scaled up so that the penalty and the learning rate suit them
            model.update(np.array(got["at"][k]), np.array(got["x"][k]) * 16, float(got["y"][k] > 0))
    return model.weights().astype(np.float32)


def score(df: DataFrame, weights: np.ndarray, text: str = "text", out: str = "score") -> DataFrame:
    """df without its text and with the score of each text from 0 to 1."""
    fields = [f for f in df.schema if f.name not in (text, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [np.empty(0)]
            for _, data, at in words.parts(batch.column(text)):
                feature, doc, n = features(data, at)
                got.append(sigmoid(16 * np.bincount(doc, weights[feature], len(at) - 1) / np.maximum(n, 1)))
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), pa.array(np.concatenate(got))], names=[*(f.name for f in fields), out])

    return df.mapInArrow(words.trimmed(run), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` double")
