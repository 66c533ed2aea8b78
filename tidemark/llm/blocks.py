"""Batches of whole texts, hashes that occur in more than one of them, and runs of sorted rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import words

#: Bytes of text in a batch, on average.
BATCH = 6 << 20
#: Bytes of sorted rows that are worked on at once, on average.
RUNS = 16 << 20
#: Counts are cut here; what matters of them is the number of parts that follow.
MOST = 2**31 - 1


def batched(df: DataFrame, id: str, text: str) -> tuple[DataFrame, int]:
    """((i, text, batch), bytes of text): documents dealt out by their id in batches of about the same size."""
    size = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    count = max(1, -(-size // BATCH))
    return df.select(F.col(id).cast("long").alias("i"), F.col(text).alias("text")).withColumn("batch", batch_of("i", count)), size


def batch_of(id: str, count: int):
    return F.pmod(F.xxhash64(id), F.lit(count)).cast("int")


ASKED = "hash long, batch int, count int"


def ask(batch: int, hashes: np.ndarray) -> pa.Table:
    """The hashes of a batch, once each with the times that they occur."""
    words.trim()
    once, times = np.unique(hashes, return_counts=True)
    return pa.table({"hash": once.view(np.int64), "batch": pa.array(np.full(len(once), batch, np.int32)), "count": np.minimum(times, MOST).astype(np.int32)})


def repeated(asked: DataFrame) -> DataFrame:
    """(batch, hash, count): for each batch those of its hashes that occur twice or more in all, with that count.

    A batch sends each hash once, however often it has it, so a hash that all documents share costs a row for each batch.
    """
    total = F.sum("count").over(Window.partitionBy("hash"))
    return asked.select("batch", "hash", F.least(total, F.lit(MOST)).cast("int").alias("count")).where("count >= 2")


def answers(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """All (hashes, counts) of a batch's answers, by hash."""
    t = t.select(["hash", "count"]).filter(pc.is_valid(t.column("hash")))
    hashes = t.column("hash").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], t.column("count").to_numpy()[order].astype(np.int64)


def known(hashes: np.ndarray, answer: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The count of each hash, 0 if it isn't among the answers."""
    if not len(answer[0]):
        return np.zeros(len(hashes), np.int64)
    at = np.minimum(np.searchsorted(answer[0], hashes), len(answer[0]) - 1)
    return np.where(answer[0][at] == hashes, answer[1][at], 0)


def in_runs(df: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table | None], schema: str, order: list[str] = [], rows: int = 20_000) -> DataFrame:  # noqa: B006
    """work(table, begins) over all rows, sorted by keys and order, in tables of whole runs of equal keys (long or int).

    A table has about `rows` rows or RUNS bytes, whichever comes first; a longer run makes one of its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, size, most, room = [], 0, 0, rows, RUNS
        for batch in batches:
            held.append(batch)
            count, size = count + len(batch), size + batch.nbytes
            if count >= most or size >= room:
                t = pa.Table.from_batches(held)
                begins = _begins(t, keys)
                if begins[-1]:
                    yield from _out(work(t.slice(0, begins[-1]), begins[:-1]))
                    t, most, room = t.slice(begins[-1]), rows, RUNS
                else:  # one run so far: twice as much before the next look
                    most, room = 2 * count, 2 * size
                held, count, size = t.to_batches(), len(t), t.nbytes
        if held:
            t = pa.Table.from_batches(held)
            yield from _out(work(t, _begins(t, keys)))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(words.trimmed(run), schema)


def _out(t: pa.Table | None) -> Iterator[pa.RecordBatch]:
    if t is not None:
        yield from t.combine_chunks().to_batches()


def _begins(t: pa.Table, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(t), bool)
    new[:1] = True
    for k in keys:
        x = t.column(k).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)
