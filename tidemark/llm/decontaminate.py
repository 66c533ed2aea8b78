"""Benchmark decontamination by pigeonhole edit matching.

An item with an error budget of k edits is cut into k + 1 pieces. If a text holds the item within k edits, one piece
is there unchanged. All pieces of a block of items are searched at once; around each hit Myers' bit-parallel recursion
finds the smallest edit distance between the item and a part of the text. Case and kinds of white space don't count.
Items too short for an edit have a budget of none and are found where they stand unchanged.

Items come in blocks whose total size has a bound, so that what is sent to the executors doesn't grow; for `find` each block
is a pass over the documents, for `without` they are filters one after another in a single pass. A worker builds the automaton
of a block once and keeps it for its later tasks.

Defined results: null texts and items match nothing, nor do items of white space alone; copies of a document each get
their own rows; an item that is given twice counts once, and of several texts of an item the nearest; other columns are not used;
ids may have any type; an empty table on either side gives an empty result. `without` looks at each row by itself, so rows that
share an id, or have none, go or stay by their own texts; it keeps null texts and columns of any name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidemark.llm import words

#: Edits allowed for each character of an item.
RATE = 0.08
#: Characters of items that are searched for in one pass.
BLOCK = 16 << 20


def normal(text: str) -> str:
    """Lower case, every white space a blank; no character is added or taken away."""
    low = text.lower() if len(text.lower()) == len(text) else "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    return low.translate(_BLANKS)


_BLANKS = {k: " " for k in (9, 10, 11, 12, 13, 0x85, 0xA0)}


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """budget + 1 pieces of nearly equal length, with their places."""
    at = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(at, at[1:], strict=False)]


class Myers:
    """The smallest edit distance of an item to any part of a text, by one integer of bits for all rows of a column."""

    def __init__(self, item: str):
        self.size = len(item)
        self.all, self.top = (1 << self.size) - 1, 1 << (self.size - 1)
        self.has: dict[str, int] = {}
        for k, c in enumerate(item):
            self.has[c] = self.has.get(c, 0) | 1 << k

    def search(self, text: str, budget: int) -> tuple[int, int] | None:
        """(distance, end) of the best place within the budget, the first of equals."""
        plus, minus, score, best = self.all, 0, self.size, None
        for end, c in enumerate(text, 1):
            eq = self.has.get(c, 0)
            across = (((eq & plus) + plus) ^ plus) | eq
            down = minus | ~(across | plus) & self.all
            less = plus & across
            if down & self.top:
                score += 1
            elif less & self.top:
                score -= 1
            down = down << 1 & self.all
            plus = (less << 1 & self.all) | ~(eq | minus | down) & self.all
            minus = down & (eq | minus)
            if score <= budget and (best is None or score < best[0]):
                best = score, end
        return best


def budget_of(item: str, rate: float) -> int:
    return int(len(item) * rate)


class Searcher:
    def __init__(self, items: list[tuple[int, str]], rate: float):
        import ahocorasick

        self.items = [(i, normal(t), budget_of(t, rate)) for i, t in items]
        self.myers = [None] * len(self.items)
        at: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, budget) in enumerate(self.items):
            for a, piece in pieces(t, budget):
                at.setdefault(piece, []).append((k, a))
        self.found = ahocorasick.Automaton()
        for piece, places in at.items():
            self.found.add_word(piece, (len(piece), places))
        self.found.make_automaton()

    def search(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(index of the item, distance, end) of each item that the text holds, at its best place."""
        text = normal(text)
        begins: dict[int, list[int]] = {}
        for end, (size, places) in self.found.iter(text):
            for k, a in places:
                # without a budget the first place is as good as any
                if k not in begins or self.items[k][2]:
                    begins.setdefault(k, []).append(end + 1 - size - a)
        for k, hits in begins.items():
            _, item, budget = self.items[k]
            self.myers[k] = self.myers[k] or Myers(item)
            best, hits = None, sorted(hits)
            n = 0
            while n < len(hits):
                # hits whose windows overlap are looked at together
                first = last = hits[n]
                while n < len(hits) and hits[n] - last <= 2 * budget:
                    last, n = hits[n], n + 1
                a, b = max(0, first - budget), min(len(text), last + len(item) + budget)
                got = self.myers[k].search(text[a:b], budget)
                if got and (best is None or (got[0], got[1] + a) < best):
                    best = got[0], got[1] + a
            if best:
                yield k, *best


#: The automaton of the block that this worker looked for last.
_KEPT: dict[str, Searcher] = {}


def _searcher(name: str, items: list[tuple], rate: float) -> Searcher:
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Searcher(items, rate)
    return _KEPT[name]


def _blocks(bench: DataFrame, item: str, item_text: str, block: int) -> Iterator[tuple[Broadcast, str]]:
    """The (item, text) pairs in blocks of about `block` characters, sent to the executors; all texts of an item are in one."""
    good = bench.select(F.col(item).alias("_item"), F.col(item_text).alias("_text")).where(F.col("_text").rlike(r"\S")).distinct()
    count = max(1, -(-(good.agg(F.sum(F.length("_text"))).first()[0] or 0) // block))
    for n in range(count):
        items = sorted((tuple(r) for r in good.where(F.pmod(F.xxhash64("_item"), F.lit(count)) == n).collect()), key=str)
        yield bench.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex


def find(docs: DataFrame, bench: DataFrame, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """(id, item, distance, end) for each document and item that it holds; `end` counts characters."""
    id_type, item_type = docs.schema[id].dataType, bench.schema[item].dataType
    schema = T.StructType([T.StructField(id, id_type), T.StructField(item, item_type), T.StructField("distance", T.IntegerType()), T.StructField("end", T.LongType())])
    arrow = to_arrow_type(item_type)

    def one(sent: Broadcast, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(name, sent.value, rate) if sent.value else None
            for batch in batches:
                rows, ids, distances, ends = [], [], [], []
                for row, value in enumerate(batch.column(1)):
                    best = {}
                    for k, distance, end in searcher.search(value.as_py()) if searcher and value.is_valid else ():
                        key = searcher.items[k][0]
                        best[key] = min(best.get(key, (distance, end)), (distance, end))
                    for key, (distance, end) in best.items():
                        rows.append(row)
                        ids.append(key)
                        distances.append(distance)
                        ends.append(end)
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(ids, arrow), pa.array(distances, pa.int32()), pa.array(ends, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[id, item, "distance", "end"])

        return docs.select(id, text).mapInArrow(words.trimmed(run), schema)

    return reduce(DataFrame.unionAll, (one(*b) for b in _blocks(bench, item, item_text, block)))


def without(docs: DataFrame, bench: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", rate: float = RATE, block: int = BLOCK) -> DataFrame:
    """The rows of docs whose texts hold no item, without a shuffle."""
    at = docs.columns.index(text)

    def one(left: DataFrame, sent: Broadcast, name: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            searcher = _searcher(name, sent.value, rate) if sent.value else None
            for batch in batches:
                clean = (not searcher or not x.is_valid or next(searcher.search(x.as_py()), None) is None for x in batch.column(at))
                yield batch.filter(pa.array(clean, pa.bool_()))

        return left.mapInArrow(words.trimmed(run), docs.schema)

    return reduce(lambda left, b: one(left, *b), _blocks(bench, item, item_text, block), docs)
