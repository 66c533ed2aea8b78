"""Near-duplicate vectors by an inverted multi-index.

Vectors are scaled to length one and cut into two halves. Each half has a codebook of its own; a cell of the product
grid is a pair of codewords, and each vector is indexed in the cell of its nearest ones. A multi-sequence traversal
visits cells in order of the sum of the two distances, as many as the target recall needs; there the cosine is computed
in double precision and decides. A pair counts if either vector visits the other's cell.

Codebooks and the number of visits are fitted on a bounded sample (SAMPLE vectors, by a hash of the id); every vector is
indexed and visits. The number of visits is the least for which the sample's vectors reach a copy at just the
threshold with the target probability.

Exact copies are summed up first and stand for one vector. Cells with many vectors or visitors are dealt out in
blocks of bounded size, each pair of blocks to one task; a block returns sums and a forest of links, never its pairs.

A vector moves once with its copies and once for each cell that it visits, as floats if it is given as such.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and those without a label or an
id, link with nothing and are components of their own; vectors of other lengths aren't compared; several rows of one id are vectors of
their own that share a node; other columns are not used; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import words
from tidemark.llm.shared import components, dropped, saved

SAMPLE = 16_384
#: Vectors that a cell of the largest label has on average; the codebooks' size follows. Every visit sends a vector, so that large cells with few visits cost less.
CELL = 2048
CODEWORDS = 2048
#: Share of links at the threshold that one direction of visits has to reach; both directions are made.
RECALL = 0.9
#: Vectors and visitors of a block at most, on average.
BLOCK, VISITORS = 4096, 8192
#: Rows that are compared with a block, or with a codebook, at once.
ROWS = 1024


def raw(column: pa.Array) -> list[bytes | None]:
    """The bytes of each vector, or None if it can have no links."""
    flat = column.values
    x = flat.fill_null(float("nan")).to_numpy(zero_copy_only=False)
    bad = np.append(0, np.cumsum(~np.isfinite(x)))
    some = np.append(0, np.cumsum(x != 0))
    at = column.offsets.to_numpy()
    good = column.is_valid().to_numpy(zero_copy_only=False) & (bad[at[1:]] == bad[at[:-1]]) & (some[at[1:]] > some[at[:-1]])
    return [x[a:b].tobytes() if g else None for a, b, g in zip(at[:-1], at[1:], good, strict=True)]


def units(parts: list[bytes], kind: str) -> np.ndarray:
    """Vectors of one length as rows of doubles of length one."""
    x = np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1).astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def codebook(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(17)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = np.concatenate([distances(x[a : a + ROWS], c).argmin(1) for a in range(0, len(x), ROWS)])
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ c.T + (c**2).sum(1), 0)


def traverse(d1: np.ndarray, d2: np.ndarray, visits: int) -> np.ndarray:
    """The `visits` cells i * K2 + j with the smallest d1[i] + d2[j] for each row, in order.

    The cell at places (a, b) of the two sorted lists comes after (a + 1)(b + 1) - 1 others at least, so only places with
    (a + 1)(b + 1) <= visits can be among them: the staircase that a multi-sequence traversal walks.
    """
    o1, o2 = np.argsort(d1, 1, kind="stable"), np.argsort(d2, 1, kind="stable")
    steps = [(a, b) for a in range(min(d1.shape[1], visits)) for b in range(min(d2.shape[1], visits // (a + 1)))]
    a, b = np.array(steps).T
    sums = np.take_along_axis(d1, o1[:, a], 1) + np.take_along_axis(d2, o2[:, b], 1)
    best = np.argsort(sums, 1, kind="stable")[:, :visits]
    return np.take_along_axis(o1[:, a] * d2.shape[1] + o2[:, b], best, 1)


def fit(sample: np.ndarray, codewords: int, cosine: float, recall: float) -> tuple[np.ndarray, np.ndarray, int]:
    """Codebooks of the two halves and the number of visits."""
    half = sample.shape[1] // 2
    c1, c2 = codebook(sample[:, :half], codewords), codebook(sample[:, half:], codewords)
    rng = np.random.default_rng(23)
    noise = rng.normal(size=sample.shape)
    noise -= (noise * sample).sum(1, keepdims=True) * sample
    noise /= np.maximum(np.linalg.norm(noise, axis=1, keepdims=True), 1e-12)
    copy = cosine * sample + np.sqrt(1 - cosine**2) * noise
    # how many cells are nearer than the copy's: sums below its own, counted row by row in sorted distances
    rank = np.empty(len(sample), np.int64)
    for k in range(0, len(sample), ROWS):
        some = slice(k, k + ROWS)
        i, j = distances(copy[some, :half], c1).argmin(1), distances(copy[some, half:], c2).argmin(1)
        d1, d2 = distances(sample[some, :half], c1), np.sort(d := distances(sample[some, half:], c2), 1)
        for n in range(len(i)):
            rank[k + n] = np.searchsorted(d2[n], d1[n, i[n]] + d[n, j[n]] - d1[n]).sum()
    return c1, c2, int(np.quantile(rank, recall)) + 1


def _links(v: np.ndarray, w: np.ndarray, cosine: float) -> np.ndarray:
    return v @ w.T >= cosine


def _block(table: pa.Table, cosine: float, kind: str) -> pa.Table:
    """(id, links, root) of the vectors of a block that have links in it."""
    home = table.column("home").to_numpy(zero_copy_only=False).astype(bool)
    ids, weight, first = (table.column(c).to_numpy() for c in ("id", "copies", "first"))
    h, o = np.flatnonzero(home), np.flatnonzero(~home)
    count = np.zeros(len(ids), np.int64)
    root = ids.copy()
    if not len(h):
        return pa.table({"id": ids[:0], "links": count[:0], "root": root[:0]})
    x = units(table.column("vec").to_pylist(), kind)
    main = bool(table.column("main")[0].as_py())
    inner = np.concatenate([_links(x[h[k : k + ROWS]], x[h], cosine) for k in range(0, len(h), ROWS)])
    np.fill_diagonal(inner, False)
    if main:  # only one of the blocks that hold these vectors counts the links among them
        count[h] += np.array([weight[h][row].sum() for row in inner])
    # whether each of the block's own vectors visits the visitor's cell, where the pair counts for it then
    probes = table.column("probes").take(pa.array(h)).combine_chunks()
    cells, back = np.unique(first[o], return_inverse=True)
    visits = np.zeros((len(h), len(cells)), bool)
    flat, at = probes.values.to_numpy(), np.repeat(np.arange(len(h)), np.diff(probes.offsets.to_numpy()))
    flat = flat[probes.offsets[0].as_py() : probes.offsets[-1].as_py()]
    place = np.minimum(np.searchsorted(cells, flat), max(len(cells) - 1, 0))
    if len(cells):
        known = cells[place] == flat
        visits[at[known], place[known]] = True
    outer = np.zeros((len(o), len(h)), bool)
    for k in range(0, len(o), ROWS):
        outer[k : k + ROWS] = _links(x[o[k : k + ROWS]], x[h], cosine)
        count[o[k : k + ROWS]] += outer[k : k + ROWS] @ weight[h]
        alone = outer[k : k + ROWS] & ~visits[:, back[k : k + ROWS]].T
        count[h] += weight[o[k : k + ROWS]] @ alone
    top = np.iinfo(np.int64).max
    linked = [(h, inner, np.flatnonzero(inner.any(1))), (o, outer, np.flatnonzero(outer.any(1)))]
    while True:
        old = root.copy()
        for rows, links, some in linked:
            for k in range(0, len(some), ROWS):
                part, mine = links[some[k : k + ROWS]], rows[some[k : k + ROWS]]
                root[mine] = np.minimum(root[mine], np.where(part, root[h][None, :], top).min(1))
                root[h] = np.minimum(root[h], np.where(part, root[mine][:, None], top).min(0))
        if (root == old).all():
            break
    some = (count > 0) | (root != ids)
    return pa.table({"id": ids[some], "links": count[some], "root": root[some]})


def find(df: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = 0.93, recall: float = RECALL, sample: int = SAMPLE) -> DataFrame:
    """(id, n_links, component_id, kept) of each row."""
    # vectors of floats stay floats until they are compared
    double = df.schema[vector].dataType.elementType != T.FloatType()
    kind = "<f8" if double else "<f4"

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(raw(batch.column(1)), pa.binary())], names=["id", "label", "vec"])

    rows = df.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>" if double else "array<float>").alias("v"), F.col(label).cast("string").alias("label"))
    rows = rows.mapInArrow(words.trimmed(prepare), "id long, label string, vec binary")
    rows = rows.withColumn("vec", F.when(F.col("label").isNotNull() & F.col("id").isNotNull(), F.col("vec"))).withColumn("size", F.octet_length("vec"))
    rows = rows.withColumn("key", F.unhex(F.md5(F.concat(F.encode("label", "UTF-8"), F.lit(b"\0"), "vec"))))
    keys = saved(rows.select("id", "key", F.when(F.col("key").isNotNull(), F.col("label")).alias("label"), "size"), "vectors")
    groups = keys.where("key IS NOT NULL").groupBy("label", "size").agg(F.approx_count_distinct("key").alias("count"))
    largest = groups.agg(F.max("count")).first()[0]
    if not largest:
        return keys.select(F.col("id").alias(id), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    good = rows.where("key IS NOT NULL")
    once = good.groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("vec").alias("vec"), F.first("size").alias("size"))
    codewords = int(np.clip(np.ceil(np.sqrt(largest / CELL)), 1, CODEWORDS))
    books = {}
    for (size,) in keys.where("key IS NOT NULL").select("size").distinct().collect():  # the lengths of vectors are few
        got = good.where(F.col("size") == size).orderBy(F.xxhash64("id"), "id").limit(sample).select("vec").toArrow().column(0).to_pylist()
        books[size] = fit(units(got, kind), codewords, cosine, recall)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, vec = batch.column("size").to_numpy(), batch.column("vec").to_pylist()
            probes: list = [None] * len(vec)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                c1, c2, visits = books[int(s)]
                for n in range(0, len(at), ROWS):
                    x = units([vec[k] for k in at[n : n + ROWS]], kind)
                    half = x.shape[1] // 2
                    for k, row in zip(at[n : n + ROWS], traverse(distances(x[:, :half], c1), distances(x[:, half:], c2), visits), strict=True):
                        probes[k] = row.astype(np.int32)
            columns = [batch.column(n) for n in ("id", "copies", "label", "size", "vec", "key")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([p[0] for p in probes], pa.int32()), pa.array(probes, pa.list_(pa.int32()))], names=["id", "copies", "label", "size", "vec", "key", "first", "probes"])

    placed = saved(once.select("id", "copies", "label", "size", "vec", "key").mapInArrow(words.trimmed(assign), "id long, copies long, label string, size int, vec binary, key binary, first int, probes array<int>"), "placed")
    place = ["label", "size", "cell"]
    visits = placed.select("id", "label", "size", F.explode("probes").alias("cell"), "first")
    cells = visits.groupBy(place).agg(F.count_if(F.col("first") == F.col("cell")).alias("own"), F.count("*").alias("all"))
    cells = cells.select(*place, F.ceil(F.col("own") / BLOCK).cast("int").alias("subs"), F.ceil(F.col("all") / VISITORS).cast("int").alias("shares")).where("subs > 0")
    deal = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n)).cast("int")
    # a vector is at home in one part of its cell, once for each share of the visitors, and visits the other parts
    at = placed.withColumn("cell", F.explode("probes")).join(cells, place)
    own = F.col("first") == F.col("cell")
    stay = at.where(own).withColumn("sub", deal("subs", 1)).withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).withColumn("home", F.lit(True))
    go = at.withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).where(~own | (F.col("sub") != deal("subs", 1))).withColumn("share", deal("shares", 2)).withColumn("home", F.lit(False))
    go = go.withColumn("probes", F.array().cast("array<int>"))
    columns = [*place, "sub", "share", "home", "id", "copies", "first", "vec", "probes", (F.col("share") == 0).alias("main")]
    blocks = stay.select(*columns).unionAll(go.select(*columns))
    found = saved(blocks.groupBy(*place, "sub", "share").applyInArrow(lambda t: _block(t, cosine, kind), "id long, links long, root long"), "links")
    sums = found.groupBy("id").agg(F.sum("links").alias("links"))
    parts = components(found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b"))).withColumnRenamed("node", "id")
    known = placed.select("key", "id", "copies").join(sums, "id", "left").join(parts, "id", "left")
    known = known.select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), F.coalesce("component", "id").alias("component"))
    done = keys.select("id", "key").join(known, "key", "left")
    done = done.select(F.col("id").alias(id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    done = saved(done.withColumn("kept", F.coalesce(F.col(id) == F.col("component_id"), F.lit(True))), "neardup")
    for table in (keys, placed, found, parts):
        dropped(table)
    return done
