"""Which tokens of two tokenizers cover the same bytes of a text, by explode, windows and group-bys.

A text is cut where a space follows a character that is neither white space nor control. Both tokenizers end a
token at every such place, and neither looks across it (`Pieces` checks that of its vocabulary), so a part
gets the same tokens wherever it stands. Each distinct part of a batch of about BATCH bytes is tokenized once.

Which tokens meet depends on their lengths alone, the part's shape. Each distinct shape of the corpus is aligned once:

- tokens are exploded with their places, and a window sums their lengths to the byte at which each ends;
- both tokenizers' tokens meet by an equi-join on shape and end, written as one group-by of both lists;
- a window from the last end back counts the common ends: the number of the group that a token is in;
- the same window gives, for each end, the token of either side that covers the bytes up to it. Two tokens overlap
  just where both cover such a stretch, so a group's links are its ends: a range join without a join.

Then the shapes' alignments go to the batches that have them, a row for each, and meet there the batch's tokens and places, which are
one row: ids take the tokens' places, and each document is put together in order. Texts are never shuffled.

Counts of linked id pairs are those of documents that hold them; they are broadcast after their number is checked, beyond BROADCAST joined
by a shuffle.

Defined results: null and empty texts, and those whose tokens' bytes differ from the text after a space, have no
tokens. Repeated rows each have their own row and count as documents of their own; extra columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe, words
from tidemark.llm.shared import saved

#: Bytes of a batch's texts from which the next one begins, and entries that are broadcast at most.
BATCH, BROADCAST = 16 << 20, 4_000_000
#: A token is packed in one int of so many bits, its length in the last SIZE bits below its id, and is negative on side B.
BITS, SIZE = 31, 10
#: Parts that are tokenized at once, parts' places of documents that are put together at once, and tokens of shapes in a task.
MOST, PLACES, TOKENS = 20_000, 1 << 18, 250_000
#: A character after which a space begins a new part.
SEEN = r"[^\s\p{Z}\p{C}]"


class Bytes:
    """A byte-level BPE vocabulary of the `tokenizers` format."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {t["content"] for t in model["added_tokens"] if t["special"]}
        byte = {c: b for b, c in enumerate(bpe.byte_characters())}
        self.codec = bpe.Codec({bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}, pattern)

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all parts, number of ids of each)."""
        ids, n = self.codec.encode_flat(parts)
        return ids.astype(np.int64), n

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, length in bytes of each id)."""
        c, p = self.codec, self.codec.piece[ids]
        return bpe.gather(c.token_bytes, c.token_start[p], c.token_size[p]), c.token_size[p]


class Pieces:
    """A sentencepiece model, without the space that it puts before a text."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as f:  # fields that are set again later in the message count
            self.model = sentencepiece.SentencePieceProcessor(model_proto=f.read() + bpe._field(3, bpe._field(3, 0)))
        named = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any("▁" in t.lstrip("▁") for t in named):
            raise ValueError("a piece holds a space after other characters, so tokens may cross parts")
        raw = [bytes([int(t[3:-1], 16)]) if self.model.is_byte(i) else t.replace("▁", " ").encode() for i, t in enumerate(named)]
        self.size = np.array([len(t) for t in raw], np.int64)
        self.start, self.raw = np.cumsum(self.size) - self.size, np.frombuffer(b"".join(raw), np.uint8)

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.model.encode(parts, num_threads=1)
        n = np.array([len(x) for x in found], np.int64)
        return np.fromiter((i for x in found for i in x), np.int64, int(n.sum())), n

    def spell(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return bpe.gather(self.raw, self.start[ids], self.size[ids]), self.size[ids]


def _loaded(a: str, b: str, pattern: str, kept: dict = {}) -> tuple[Bytes, Pieces]:  # noqa: B006
    if (a, b, pattern) not in kept:
        kept.clear()
        kept[a, b, pattern] = Bytes(SparkFiles.get(a), pattern), Pieces(SparkFiles.get(b))
    return kept[a, b, pattern]


def _spelled(tokenizer: Bytes | Pieces, parts: list[str], data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed tokens, number of tokens of each part, whether its tokens spell it)."""
    ids, n = tokenizer.encode(parts)
    spelled, size = tokenizer.spell(ids)
    if len(spelled) == len(data) and (spelled == data).all() and (np.add.reduceat(np.append(size, 0), np.cumsum(n) - n) * (n > 0) == np.diff(at)).all():
        right = np.ones(len(parts), bool)
    else:
        first, place = np.cumsum(n) - n, np.append(0, np.cumsum(size))
        raw, want = spelled.tobytes(), data.tobytes()
        right = np.array([raw[place[f] : place[f + k]] == want[x:y] for f, k, x, y in zip(first, n, at, at[1:], strict=False)], bool)
    if len(ids) and (int(size.max()) >= 1 << SIZE or int(ids.max()) >= 1 << BITS - SIZE):
        raise ValueError("a token's id or length is too large to be packed")
    return (ids << SIZE | size).astype(np.int32), n, right


def _visible(codes: np.ndarray) -> np.ndarray:
    """Whether each character is neither white space nor control."""
    import regex

    once, which = np.unique(codes, return_inverse=True)
    return np.array([regex.match(SEEN, chr(c), flags=regex.V0) is not None for c in once.tolist()], bool)[which]


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(parts of all texts, each after a space; number of parts of each text)."""
    fixed = lambda x: pa.scalar(x, pa.large_string())
    data, at = words.utf8(pc.binary_join_element_wise(fixed(" "), texts.cast(pa.large_string()), fixed("")))
    space = np.flatnonzero(data == 32)[1:]
    last = data[space - 1]
    new = (last > 32) & (last < 127)
    wide = np.flatnonzero(last > 127)
    code, open = last[wide].astype(np.int64) & 63, np.ones(len(wide), bool)
    for k in (1, 2, 3):
        byte = data[np.maximum(space[wide] - 1 - k, 0)].astype(np.int64)
        code |= np.where(open, (byte & np.where(byte < 0xC0, 63, 63 >> k)) << 6 * k, 0)
        open &= byte < 0xC0
    new[wide] = _visible(code)
    begin = np.union1d(at[:-1], space[new])
    return _spans(pa.large_string(), np.append(begin, len(data)), data), np.diff(np.append(np.searchsorted(begin, at[:-1]), len(begin)))


def _spans(kind: pa.DataType, at: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(kind, len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])


def _put(x: np.ndarray) -> bytes:
    """The numbers as compressed 32-bit ones, their first bytes first; `_got` gives them back."""
    raw = np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()
    return struct.pack("<q", len(raw)) + (pa.compress(raw, "zstd", asbytes=True) if raw else b"")


def _got(x: bytes) -> np.ndarray:
    (size,) = struct.unpack("<q", x[:8])
    raw = pa.decompress(x[8:], size, "zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<i4")[:, 0]


def packed(parts: pa.Array, one: Bytes, two: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed side, id, length of each part's tokens, A's first; number of tokens of each part; whether both sides spell it)."""
    data, at = words.utf8(parts)
    texts = parts.to_pylist()
    x, n, ok = _spelled(one, texts, data, at)
    y, m, also = _spelled(two, texts, data, at)
    both = np.empty(len(x) + len(y), np.int32)
    begin = np.cumsum(n + m) - n - m
    both[np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(len(x))] = x
    both[np.repeat(begin + n - (np.cumsum(m) - m), m) + np.arange(len(y))] = ~y
    return both, n + m, ok & also


_TOKENS = pa.schema([("batch", pa.int64()), ("ids", pa.list_(pa.int64())), *((n, pa.binary()) for n in ("counts", "places", "shapes", "tokens")), ("asked", pa.list_(pa.list_(pa.int16())))])


def _batch(number: int, found: list[pa.Array], counts: np.ndarray, ids: list[int | None], one: Bytes, two: Pieces) -> pa.RecordBatch:
    """The row of a batch, from its parts: see tokenized()."""
    coded = pa.chunked_array(found).dictionary_encode().unify_dictionaries()
    found.clear()
    parts, packs = coded.chunk(0).dictionary, [_put(x) for x in (counts, np.concatenate([c.indices.to_numpy() for c in coded.chunks]))]
    del coded
    words.trim()
    tokens, size, right = map(np.concatenate, zip(*(packed(parts.slice(k, MOST), one, two) for k in range(0, len(parts), MOST)), strict=True))
    tokens, size = tokens[np.repeat(right, size)], size[right]
    second, token = tokens < 0, np.where(tokens < 0, ~tokens, tokens)
    length = token & (1 << SIZE) - 1
    every = _spans(pa.large_binary(), np.append(0, np.cumsum(2 * size)), np.where(second, ~length, length).astype("<i2").view(np.uint8)).dictionary_encode()
    shapes = np.full(len(parts), -1)
    shapes[right] = every.indices.to_numpy()
    data, at = words.utf8(every.dictionary)
    asked = pa.ListArray.from_arrays(pa.array((at // 2).astype(np.int32)), pa.array(np.frombuffer(data, "<i2")))
    asked = pa.ListArray.from_arrays(pa.array([0, len(asked)], pa.int32()), asked)
    packs = [pa.array([x], pa.binary()) for x in (*packs, _put(shapes), _put(token >> SIZE))]
    return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([ids], pa.list_(pa.int64())), *packs, asked], schema=_TOKENS)


def tokenized(docs: DataFrame, a: str, b: str, pattern: str) -> DataFrame:
    """(batch, ids, counts, places, shapes, tokens, asked): one row for each batch of documents (id, text).

    It has the ids of its documents, the number of parts of each, and in order the numbers of these parts among the batch's distinct ones;
    the number of each distinct part's shape among `asked`, the batch's distinct shapes (-1 where either side doesn't spell the part), and
    the tokens' ids. A shape is the lengths of A's tokens and those of B's, the latter as -1 - length. Numbers are packed by `_put`.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = _loaded(a, b, pattern)
        number = TaskContext.get().partitionId() << 32
        held, counts, ids, size = [], [], [], 0
        for batch in batches:
            for piece in bpe.groups(batch.column("text")):
                some = batch.slice(piece.start, piece.stop - piece.start)
                parts, n = cut(some.column("text"))
                held.append(parts)
                counts.append(n)
                ids += some.column("id").to_pylist()
                size += len(words.utf8(parts)[0])
                if size >= BATCH:
                    yield _batch(number, held, np.concatenate(counts), ids, one, two)
                    number, held, counts, ids, size = number + 1, [], [], [], 0
                    words.trim()
        if held:
            yield _batch(number, held, np.concatenate(counts), ids, one, two)
        one.codec.forget()

    kind = "batch long, ids array<long>, counts binary, places binary, shapes binary, tokens binary, asked array<array<smallint>>"
    return docs.select("id", "text").mapInArrow(words.trimmed(run), kind)


def shapes_aligned(shapes: DataFrame, tasks: int) -> DataFrame:
    """(u, k, g, a, b) of each shape (u, shape): its tokens in the order in which they are written (-1 - token on side B), the group of each,
    and A's and B's token of each link, as arrays of numbers, which take a fifth of the room of structs.

    Tokens are told by their place in the shape; groups are numbered up to -1.
    """
    flat = shapes.select("u", "shape").repartition(tasks, "u").select("u", F.posexplode("shape").alias("k", "x"))
    second = F.col("x") < 0
    own = Window.partitionBy("u", second).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    flat = flat.withColumn("end", F.sum(F.when(second, -1 - F.col("x")).otherwise(F.col("x"))).over(own))
    ends = flat.groupBy("u", "end").agg(F.max(F.when(~second, F.col("k"))).alias("a"), F.max(F.when(second, F.col("k"))).alias("b"))
    back = Window.partitionBy("u").orderBy(F.desc("end")).rowsBetween(Window.unboundedPreceding, 0)
    common = F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).over(back)
    cover = F.struct(F.last("a", ignorenulls=True).over(back).alias("a"), F.last("b", ignorenulls=True).over(back).alias("b"))
    done = ends.withColumns({"g": -common.cast("int"), "link": cover}).groupBy("u").agg(F.collect_list("link").alias("links"), F.collect_list(F.struct("g", "a", "b")).alias("ends"))
    side = lambda second, name: F.transform(F.filter("ends", lambda x: x[name].isNotNull()), lambda x: F.struct(x["g"].alias("g"), F.lit(second).alias("second"), x[name].alias("k")))
    done = done.select("u", F.array_sort(F.concat(side(False, "a"), side(True, "b"))).alias("wrote"), "links")
    told = F.transform("wrote", lambda x: F.when(x["second"], -1 - x["k"]).otherwise(x["k"]))
    return done.select("u", told.alias("k"), F.col("wrote.g").alias("g"), F.col("links.a").alias("a"), F.col("links.b").alias("b"))


def _numbers(max_id: int, kept: dict = {}) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: B006
    """(bytes, beginnings, sizes) of each id before "," at 3 * id, "|" and ";" next to it, up to max_id at least."""
    if kept.get("most", -1) < max_id:
        most = max(max_id, 1 << 16)
        every = [f"{i}{c}".encode() for i in range(most + 1) for c in ",|;"]
        size = np.array([len(x) for x in every], np.int64)
        kept.update(most=most, all=(np.frombuffer(b"".join(every), np.uint8), np.cumsum(size) - size, size))
    return kept["all"]


def _lists(answers: pa.Table, *names: str) -> tuple[np.ndarray, ...]:
    """(beginnings, sizes, flat values of each name) of columns of arrays of equal lengths."""
    columns = [answers.column(n).combine_chunks() for n in names]
    at = columns[0].offsets.to_numpy().astype(np.int64)
    return at[:-1] - at[0], np.diff(at), *(c.flatten().to_numpy().astype(np.int64) for c in columns)


def _written(ids: np.ndarray, k: np.ndarray, sign: np.ndarray, first: np.ndarray, n: np.ndarray) -> list[bytes]:
    """The ids of each part in the order k, with the signs that follow them; first, n: where a part's shape begins in k and sign, and its tokens."""
    data, start, length = _numbers(int(ids.max(initial=0)))
    base, out = np.cumsum(n) - n, []
    for at in range(0, len(n), MOST):
        f, m = first[at : at + MOST], n[at : at + MOST]
        key = 3 * ids[bpe.gather(k, f, m) + np.repeat(base[at : at + MOST], m)] + bpe.gather(sign, f, m)
        spelled = bpe.gather(data, start[key], length[key]).tobytes()
        ends = np.append(0, np.cumsum(length[key]))[np.append(0, np.cumsum(m))].tolist()
        out += [spelled[x:y] for x, y in zip(ends, ends[1:], strict=False)]
    return out


_TOLD = pa.schema([("id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")), ("groups", pa.string()), ("pairs", pa.list_(pa.struct([(n, pa.int32()) for n in ("a", "b", "n")])))])


def _told(batch: pa.Table, answers: pa.Table) -> Iterator[pa.RecordBatch]:
    """The documents of a batch's row, from the alignments of its shapes (s, k, g, a, b).

    An id has BITS - SIZE bits, so a document's number among PLACES and an id pair go into one number.
    """
    ids = batch.column("ids").combine_chunks().flatten()
    counts, places, shapes, tokens = (_got(batch.column(n)[0].as_py()) for n in ("counts", "places", "shapes", "tokens"))
    answers = answers.sort_by("s")
    begin, size, k, g = _lists(answers, "k", "g")
    at, links, a, b = _lists(answers, "a", "b")
    second, k = k < 0, np.where(k < 0, -1 - k, k)
    # what follows a written token: "," on its side, "|" before the other one, ";" after a group or a part
    edge = np.ones(len(g), bool)
    edge[:-1] = g[1:] != g[:-1]
    edge[begin[size > 0][1:] - 1] = True
    sign = np.where(edge, 2, np.append(second[1:] != second[:-1], False) if len(g) else 0)
    total = lambda x: np.diff(np.append(0, np.cumsum(x))[np.append(begin, len(x))])
    n_b, n_groups = total(second), total(edge)
    of = lambda values: np.where(shapes >= 0, values[shapes], 0) if len(values) else np.zeros(len(shapes), np.int64)
    # of each distinct part: its tokens as they are written, and its links
    first, n = of(begin), of(size)
    base = np.cumsum(n) - n
    written = _written(tokens, k, sign, first, n)
    first, m = of(at), of(links)
    linked, each = np.cumsum(m) - m, [of(size - n_b), of(n_b), of(n_groups), m]
    wide = int(tokens.max(initial=0)) + 1
    pair = np.empty(int(m.sum()), np.int64)
    for k in range(0, len(m), MOST):
        some = slice(k, k + MOST)
        own = np.repeat(base[some], m[some])
        ends = (tokens[bpe.gather(x, first[some], m[some]) + own] for x in (a, b))
        pair[linked[k] : linked[k] + len(own)] = next(ends).astype(np.int64) * wide + next(ends)
    stop = np.cumsum(counts)
    i = 0
    while i < len(counts):
        low = stop[i] - counts[i]
        j = max(i + 1, int(np.searchsorted(stop, low + PLACES, "right")))
        p, to = places[low : stop[j - 1]], np.append(0, stop[i:j] - low)
        valid = np.minimum.reduceat(shapes[p], to[:-1]) >= 0
        told = [np.where(valid, np.add.reduceat(x[p], to[:-1]), 0) for x in each]
        spots = p.tolist()
        groups = [b"".join([written[x] for x in spots[x:y]])[:-1] if ok else None for ok, x, y in zip(valid.tolist(), to.tolist(), to[1:].tolist(), strict=False)]
        some = m[p] * np.repeat(valid, counts[i:j])
        row = np.repeat(np.repeat(np.arange(j - i), counts[i:j]), some)
        once, times = np.unique(row * wide**2 + bpe.gather(pair, linked[p], some), return_counts=True)
        row, once = once // wide**2, once % wide**2
        flat = pa.StructArray.from_arrays([pa.array(x.astype(np.int32)) for x in (once // wide, once % wide, times)], ["a", "b", "n"])
        listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(j - i + 1)).astype(np.int32)), flat)
        yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), *map(pa.array, told), pa.array(groups, pa.binary()).cast(pa.string()), listed], schema=_TOLD)
        i = j


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The documents of all batches, whose rows and answers come one after another."""
    held: list[pa.RecordBatch] = []

    def told() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        held.clear()
        own = pc.is_null(t.column("s"))
        yield from _told(t.filter(own).select(["ids", "counts", "places", "shapes", "tokens"]), t.filter(pc.invert(own)).select(["s", "k", "g", "a", "b"]))
        words.trim()

    for batch in batches:
        number = batch.column("batch").to_numpy()
        for some in np.split(np.arange(len(number)), np.flatnonzero(number[1:] != number[:-1]) + 1):
            if held and len(some) and held[0].column("batch")[0].as_py() != number[some[0]]:
                yield from told()
            if len(some):
                held.append(batch.slice(some[0], len(some)))
    if held:
        yield from told()


def align(docs: DataFrame, a: str, b: str, pattern: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, groups, pairs) of each text; without tokens zeros, no groups (null) and no pairs.

    a: path of a byte-level BPE vocabulary of the `tokenizers` format, cut by `pattern`; b: path of a sentencepiece model. groups: text
    as `a1,a2|b1;a3|b2,b3`; pairs: array of (a, b, n), the ids that are linked with how often they are.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).where("text != ''")
    found = saved(tokenized(keyed, bpe.share(spark, a), bpe.share(spark, b), pattern), "tokens")
    asked = found.select("batch", F.posexplode("asked").alias("s", "shape"))
    # a shape's row has as many places as there are batches, at most
    shapes = saved(asked.groupBy("shape").agg(F.collect_list(F.struct("batch", "s")).alias("at")).withColumn("u", F.monotonically_increasing_id()), "shapes")
    tasks = max(1, (shapes.agg(F.sum(F.size("shape").cast("long"))).first()[0] or 0) // TOKENS)
    answers = shapes_aligned(shapes, tasks).join(shapes.select("u", "at"), "u").select(F.explode("at").alias("at"), "k", "g", "a", "b").select("at.batch", "at.s", "k", "g", "a", "b")
    kind = "id long, n_a long, n_b long, n_groups long, n_links long, groups string, pairs array<struct<a:int,b:int,n:int>>"
    both = found.drop("asked").unionByName(answers, allowMissingColumns=True)
    told = both.repartition("batch").sortWithinPartitions("batch").mapInArrow(words.trimmed(_each), kind).withColumnRenamed("id", id)
    nothing = F.lit(0).cast("long")
    empty = docs.where(F.col(text).isNull() | (F.col(text) == "")).select(F.col(id), nothing.alias("n_a"), nothing, nothing, nothing, F.lit(None).cast("string"), F.lit([]).cast(told.schema["pairs"].dataType))
    return told.unionAll(empty)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, docs, best): how many documents hold each linked id pair, and whether no other pair of its A id is in more."""
    counts = aligned.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("docs"))
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))  # as many rows of an A id as B has ids, at most


def scored(aligned: DataFrame, keep: list[str]) -> DataFrame:
    """(keep, n_best, count_sum) of each row of `aligned`, a written table: links whose pair is the best of its A id, and the sum of all links' counts."""
    found = saved(pair_counts(aligned), "pairs")
    flat = aligned.withColumn("row", F.monotonically_increasing_id()).select("row", *keep, F.explode_outer("pairs").alias("p")).select("row", *keep, "p.a", "p.b", "p.n")
    told = flat.join(F.broadcast(found) if found.count() <= BROADCAST else found, ["a", "b"], "left")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return told.groupBy("row", *keep).agg(total(F.when(F.col("best"), F.col("n"))).alias("n_best"), total(F.col("n") * F.col("docs")).alias("count_sum")).drop("row")
