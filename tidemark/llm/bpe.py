"""Byte-level BPE through a sentencepiece model that is serialised straight from a rank file.

A rank file names byte strings and their merge ranks. Each byte is mapped to one printable character, so that every
string of the vocabulary becomes a piece; a piece scores its negative rank, and the normaliser is the identity.
Sentencepiece then merges the pair with the highest score first, the leftmost one of equals, which is the order of the
ranks. Text is cut into pre-tokens by a pattern first; merges never cross them.

Defined results: a null text counts as empty and has no ids; copies get equal ids; other columns are kept as they are
unless they have the name of an output column, which replaces them; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import words

#: Pre-tokens that a task remembers at most; above that it starts anew, which changes no result.
CACHE = 150_000
#: Ids that are turned into bytes at once.
SLICE = 1 << 18


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next one from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a file of lines "base64 rank"."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """A protobuf field: a message or string, an integer or a 32-bit float."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised model; piece k has the k-th smallest rank, and the unknown piece comes last."""
    chars = byte_characters()
    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
    pieces = b"".join(
        _field(1, _field(1, "".join(chars[b] for b in token).encode()) + _field(2, -float(rank)) + _field(3, 1))
        for token, rank in sorted(ranks.items(), key=lambda x: x[1])
    )
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1) + _field(40, len(ranks)) + b"".join(_field(n, -1) for n in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return pieces + unknown + _field(2, trainer) + _field(3, normalizer)


class Codec:
    """Encodes and decodes with the model; one for each Python worker."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern, self.model = ranks, pattern, None
        tokens = sorted(ranks, key=ranks.get)
        self.rank = np.array([ranks[t] for t in tokens], np.uint32)
        self.piece = np.zeros(int(self.rank.max()) + 1, np.int64)
        self.piece[self.rank] = np.arange(len(tokens))
        self.token_size = np.array([len(t) for t in tokens], np.int64)
        self.token_start = np.cumsum(self.token_size) - self.token_size
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.ids, self.start, self.size = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, new: list[str]) -> None:
        """Encodes pre-tokens that haven't been seen."""
        found = self.model.encode([t.encode().decode("latin-1").translate(self.table) for t in new], num_threads=1)
        self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
        size = np.array([len(x) for x in found], np.int64)
        flat = np.fromiter((i for x in found for i in x), np.int64, int(size.sum()))
        self.start = np.concatenate([self.start, len(self.ids) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.ids = np.concatenate([self.ids, self.rank[flat]])

    def encode_many(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for tokens in self.known(texts):
            at = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
            yield gather(self.ids, self.start[at], self.size[at])

    def encode_flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), for many short texts."""
        cut = self.known(texts)
        tokens = [t for c in cut for t in c]
        at = np.fromiter(map(self.index.__getitem__, tokens), np.int64, len(tokens))
        last = np.cumsum([len(c) for c in cut], dtype=np.int64)
        return gather(self.ids, self.start[at], self.size[at]), np.diff(np.append(0, np.cumsum(self.size[at]))[last], prepend=0)

    def known(self, texts: list[str | None]) -> list[list[str]]:
        """The pre-tokens of each text, all of which are in the index afterwards."""
        if self.model is None:
            import regex
            import sentencepiece

            self.find = regex.compile(self.pattern).findall
            self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
            self.table = dict(enumerate(byte_characters()))
        cut = [self.find(t) if t else [] for t in texts]
        new = set().union(*cut).difference(self.index)
        if new:
            if len(self.index) + len(new) > CACHE:
                self.forget()
                new = set().union(*cut)
            self.learn(list(new))
        return cut

    def decode(self, ids: np.ndarray) -> bytes:
        parts = (self.piece[ids[k : k + SLICE]] for k in range(0, len(ids), SLICE))
        return b"".join(gather(self.token_bytes, self.token_start[p], self.token_size[p]).tobytes() for p in parts)


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices values[start:start + size], one after another."""
    if not len(start):
        return values[:0]
    return values[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]


def groups(column: pa.Array, most: int = 1 << 19) -> Iterator[slice]:
    """Slices of about `most` bytes, so that no more than that is held as pre-tokens or ids."""
    begin, held = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
        held += n
        if held >= most:
            yield slice(begin, k + 1)
            begin, held = k + 1, 0
    if begin < len(column):
        yield slice(begin, len(column))


def _codec(vocabulary: bytes | str, pattern: str, kept: dict = {}) -> Codec:  # noqa: B006
    if (vocabulary, pattern) not in kept:
        kept.clear()
        kept[vocabulary, pattern] = Codec(read_ranks(SparkFiles.get(vocabulary)), pattern)
    return kept[vocabulary, pattern]


def share(spark: SparkSession, path: str) -> str:
    """Sends a vocabulary file to all executors; returns the name that it has there."""
    spark.sparkContext.addFile(path)
    return path.rsplit("/", 1)[-1]


def _replaced(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), values], names=[*keep, name])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids", keep_text: bool = False, decoded: str | None = None) -> DataFrame:
    """df with the ids of `text` as packed little-endian unsigned 32-bit integers in the binary column `out`.

    `unpack` makes an array of them. The text column is dropped unless keep_text is set. With `decoded`, that binary
    column has the bytes that the ids stand for, as `decode` would give them, without a second pass of workers.
    """
    name = share(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        for batch in batches:
            for part in groups(batch.column(text)):
                some = batch.slice(part.start, part.stop - part.start)
                ids = [i.astype("<u4").tobytes() for i in codec.encode_many(some.column(text).to_pylist())]
                done = _replaced(some if keep_text else some.drop_columns([text]), out, pa.array(ids, pa.binary()))
                if decoded:
                    done = _replaced(done, decoded, pa.array([codec.decode(np.frombuffer(x, "<u4")) for x in ids], pa.binary()))
                yield done
        codec.forget()

    added = [out, *([decoded] if decoded else [])]
    fields = [f for f in df.schema if f.name not in added and (keep_text or f.name != text)]
    return df.mapInArrow(words.trimmed(run), T.StructType([*fields, *(T.StructField(n, T.BinaryType()) for n in added)]))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the bytes that the packed `ids` stand for in the binary column `out`."""
    name = share(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, pattern)
        for batch in batches:
            for part in groups(batch.column(ids), 4 << 19):
                some = batch.slice(part.start, part.stop - part.start)
                got = [codec.decode(np.frombuffer(x or b"", "<u4")) for x in some.column(ids).to_pylist()]
                yield _replaced(some, out, pa.array(got, pa.binary()))

    fields = [f for f in df.schema if f.name != out]
    return df.mapInArrow(words.trimmed(run), T.StructType([*fields, T.StructField(out, T.BinaryType())]))


def unpack(ids: str = "ids") -> F.Column:
    """The packed ids as array<bigint>."""
    one = " || ".join(f"hex(substring({ids}, cast(4 * k + {b} AS int), 1))" for b in (4, 3, 2, 1))
    each = f"transform(sequence(0L, octet_length({ids}) div 4 - 1), k -> cast(conv({one}, 16, 10) AS bigint))"
    return F.expr(f"CASE WHEN octet_length({ids}) = 0 THEN cast(array() AS array<bigint>) ELSE {each} END")
