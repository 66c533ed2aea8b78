"""Neighbourhoods of a graph by blocks of nodes: what pairs of neighbours have in common, without a row for each such pair, however neighbours are spread.

Nodes get numbers, and a number belongs to a block by its remainder. Each node's neighbours are one list, whose entries are sent packed (two or
three bytes each) to the tasks of every two blocks that need them. What a task keeps is bounded by HELD entries of a block; what is shuffled
is the edges times the number of blocks, not the paths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources import tables

#: Entries of a block that a task keeps, entries that are packed at once, paths that are looked at at once.
HELD, PACKED, PATHS = 1 << 25, 1 << 21, 1 << 20
#: Nodes whose neighbours are flagged at once, and flags of each (a power of two).
TOGETHER, SIDE = 128, 1 << 16
#: What is counted of the paths of a node: different ends, different kinds of ends, neighbours, paths, those to an end of some kind, of the same kind, of the same brand, of both.
REACHED = ("size", "types", "degree", "others", "typed", "same_kind", "same_brand", "both")


def numbered(keys: DataFrame, key: str, rows: int, weight: Column | None = None) -> DataFrame:
    """keys, a row for each different key, with `number`: an int from 0 with few gaps that grows with the weight, about. Keys are numbered in as many windows as `rows` ask for."""
    parts = max(1, -(-rows // tables.DEALT))
    bucket = F.pmod(F.xxhash64(key), F.lit(parts))
    w = Window.partitionBy("_bucket").orderBy(*([] if weight is None else [weight]), key)
    return keys.withColumn("_bucket", bucket).withColumn("number", ((F.row_number().over(w) - 1) * parts + F.col("_bucket")).cast("int")).drop("_bucket")


def lists(pairs: DataFrame, rows: int) -> DataFrame:
    """(node, near): the different numbers among the arrays `near` of each node's rows, in order."""
    return tables.dealt(pairs, rows, "node").groupBy("node").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("near")))).alias("near"))


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays of numbers below 2 ** 32, byte by byte: the lowest bytes of all, then the next ones."""
    planes = [np.ascontiguousarray(a, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for a in arrays]
    return np.array([len(arrays), *(len(a) for a in arrays)], "<i8").tobytes() + zlib.compress(b"".join(planes), 1)


def _unpacked(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<i8", 1)[0])
    sizes = np.frombuffer(data, "<i8", n, 8)
    planes, at, out = np.frombuffer(zlib.decompress(data[8 * (n + 1) :]), np.uint8), 0, []
    for size in map(int, sizes):
        out.append(np.ascontiguousarray(planes[at : at + 4 * size].reshape(4, size).T).view("<u4").ravel().astype(np.int64))
        at += 4 * size
    return out


def _gaps(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Lists in order, as the first value of each and the steps from there."""
    out = np.diff(values, prepend=0)
    first = (np.cumsum(lens) - lens)[lens > 0]
    out[first] = values[first]
    return out


def _values(gaps: np.ndarray, lens: np.ndarray) -> np.ndarray:
    some = lens[lens > 0]
    first = np.cumsum(some) - some
    total = np.cumsum(gaps)
    return total - np.repeat(total[first] - gaps[first], some)


def _fold(x: np.ndarray) -> np.ndarray:
    """Numbers of both signs as numbers from 0."""
    return np.where(x >= 0, 2 * x, -2 * x - 1)


def _some(values: np.ndarray, lens: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values to keep, and how many each list has of them."""
    upto = np.concatenate([[0], np.cumsum(keep)])
    ends = np.cumsum(lens)
    return values[keep], upto[ends] - upto[ends - lens]


def _runs(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, ... of all k, lens[k] of each."""
    return np.repeat(starts - (np.cumsum(lens) - lens), lens) + np.arange(lens.sum())


def _pieces(sizes: np.ndarray, most: int, rows: int | None = None) -> Iterator[slice]:
    """Slices of which each has a sum of sizes up to `most`, or one row."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        upto = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right"))
        upto = max(at + 1, min(upto, at + rows if rows else upto))
        yield slice(at, upto)
        at = upto


class _Lists:
    """Lists that are added part by part, then found by their place."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []

    def add(self, places: np.ndarray, lens: np.ndarray, values: np.ndarray) -> None:
        self.parts.append((places, lens, values.astype(np.int32)))

    def end(self) -> None:
        size = max((int(p.max()) + 1 for p, _, _ in self.parts if len(p)), default=0)
        self.start, self.len, at = np.zeros(size, np.int64), np.zeros(size, np.int64), 0
        self.values = np.empty(sum(len(v) for _, _, v in self.parts), np.int32)
        while self.parts:
            places, lens, values = self.parts.pop()
            self.values[at : at + len(values)] = values
            self.start[places], self.len[places] = at + np.cumsum(lens) - lens, lens
            at += len(values)

    def lens(self, places: np.ndarray) -> np.ndarray:
        there = places < len(self.len)
        return np.where(there, self.len[np.where(there, places, 0)], 0) if len(self.len) else np.zeros(len(places), np.int64)


def _column(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of a column of lists."""
    c = batch.column(name)
    ends = c.offsets.to_numpy().astype(np.int64)
    return np.diff(ends), c.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64)


def _gathered(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches with about PACKED entries each."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows + len(batch.column(column).values)
        if n >= PACKED:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _sent(packed: DataFrame, tasks: Column, count: int) -> DataFrame:
    """Packed parts at all their tasks, each of which is a partition and gets its parts by role."""
    return packed.withColumn("task", F.explode(tasks.cast("array<int>"))).repartitionById(count, "task").sortWithinPartitions("task", "role")


def _messages(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    role, block, data = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(role, pa.int32()), pa.array(block, pa.int32()), pa.array(data, pa.binary())], ["role", "block", "data"])


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, int, list[np.ndarray]]]:
    for batch in batches:
        columns = [batch.column(n).to_pylist() for n in ("task", "role", "block")]
        for k, (task, role, block) in enumerate(zip(*columns, strict=True)):
            yield task, role, block, _unpacked(batch.column("data")[k].as_py())


def triangles(near: DataFrame, entries: int) -> DataFrame:
    """(node, degree, connected): a node's neighbours, and how many ordered pairs of them are neighbours of each other.

    near: (node, near), the numbers above the node's own among its neighbours. A triangle is found once, where its lowest edge is: in the task of
    the two blocks of that edge. entries: about how many numbers all lists have.
    """
    blocks = max(4, -(-entries // HELD))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, "near"):
            node, (lens, values) = batch.column("node").to_numpy().astype(np.int64), _column(batch, "near")
            order = np.argsort(node, kind="stable")
            starts = np.cumsum(lens) - lens
            for b in range(blocks):
                mine = order[node[order] % blocks == b]
                if len(mine):
                    at = node[mine] // blocks
                    yield _messages([(0, b, _packed(np.diff(at, prepend=0), lens[mine], _gaps(values[_runs(starts[mine], lens[mine])], lens[mine])))])

    def counted(task: int, held: dict[int, _Lists]) -> Iterator[pa.RecordBatch]:
        i, j = divmod(task, blocks)
        for x in held.values():
            x.end()
        top = max((int(x.values.max(initial=-1)) + 1 for x in held.values()), default=0)
        top = max([top, *(len(x.len) * blocks for x in held.values())])
        degree, found = np.zeros(top, np.int64), np.zeros(top, np.int64)
        if i == j:
            degree += np.bincount(held[i].values, minlength=top)
            degree[np.arange(len(held[i].len)) * blocks + i] += held[i].len
        flags = np.zeros(TOGETHER * SIDE, bool)
        for a, b in dict.fromkeys([(i, j), (j, i)]):
            if a in held and b in held:
                _closed(held[a], a, held[b], b, blocks, flags, found)
        some = np.flatnonzero(degree + found)
        for at in range(0, len(some), PATHS):
            k = some[at : at + PATHS]
            yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(degree[k], pa.int64()), pa.array(found[k], pa.int64())], ["node", "degree", "connected"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = {}, None
        for task, _, block, (at, lens, gaps) in _told(batches):
            if last is not None and task != last:
                yield from counted(last, held)
                held = {}
            last = task
            held.setdefault(block, _Lists()).add(np.cumsum(at), lens, _values(gaps, lens))
        if last is not None:
            yield from counted(last, held)

    parts = near.mapInArrow(packed, "role int, block int, data binary")
    pair = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda x: F.least("block", x) * blocks + F.greatest("block", x))
    found = _sent(parts, pair, blocks * blocks).mapInArrow(met, "node int, degree long, connected long")
    return found.groupBy("node").agg(F.sum("degree").alias("degree"), F.sum("connected").alias("connected"))


def _closed(from_: _Lists, a: int, to: _Lists, b: int, blocks: int, flags: np.ndarray, found: np.ndarray) -> None:
    """Adds 2 to each node of each triangle whose lowest edge goes from block a to block b: its two others are neighbours, in both orders."""
    rows = np.flatnonzero(from_.len)
    for some in _pieces(from_.len[rows], PATHS, TOGETHER):
        u = rows[some]
        lens = from_.len[u]
        values = from_.values[_runs(from_.start[u], lens)].astype(np.int64)
        of = np.repeat(np.arange(len(u)), lens)
        keys = (of << 32) | values
        edge = np.flatnonzero(values % blocks == b)
        place = values[edge] // blocks
        size = to.lens(place)
        edge, place, size = edge[size > 0], place[size > 0], size[size > 0]
        if not len(edge):
            continue
        at = of * SIDE + (values & (SIDE - 1))
        flags[at] = True
        for piece in _pieces(size, PATHS):
            third = to.values[_runs(to.start[place[piece]], size[piece])].astype(np.int64)
            by = np.repeat(edge[piece], size[piece])
            maybe = np.flatnonzero(flags[of[by] * SIDE + (third & (SIDE - 1))])
            third, by = third[maybe], by[maybe]
            wanted = (of[by] << 32) | third
            sure = keys[np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)] == wanted
            for node in (u[of[by[sure]]] * blocks + a, values[by[sure]], third[sure]):
                np.add.at(found, node, 2)
        flags[at] = False


def paths(near: DataFrame, entries: int) -> DataFrame:
    """(node, and the sums of REACHED): the paths of two edges from each node that has a number from 0, to its own kind too where they come back to it.

    near: (node, kind, brand, near, kinds): near has the numbers of all neighbours, below zero those of nodes that are only passed through;
    kinds has the kinds among the others. Kind and brand are numbers from 0, -1 for none. A task keeps what one block's nodes are neighbours of; the nodes of a
    part of all come by with their lists. entries: about how many numbers all lists have.
    """
    ends = -(-entries // (2 * HELD))
    starts = max(2, -(-12 // ends))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _gathered(batches, "near"):
            node, kind, brand = (batch.column(n).to_numpy().astype(np.int64) for n in ("node", "kind", "brand"))
            (lens, values), (klens, kinds) = _column(batch, "near"), _column(batch, "kinds")
            for j in range(ends):
                v, n = _some(values // ends, lens, (values >= 0) & (values % ends == j))
                k, kn = _some(kinds // ends, klens, kinds % ends == j)
                mine = np.flatnonzero((node >= 0) & (node % ends == j))
                yield _messages([(0, j, _packed(_fold(node), n, _gaps(v, n), kn, k, node[mine] // ends, kind[mine] + 1, brand[mine] + 1))])
            first = np.cumsum(lens) - lens
            for i in range(starts):
                mine = np.flatnonzero((node >= 0) & (node % starts == i))
                v, n = values[_runs(first[mine], lens[mine])], lens[mine]
                below = np.array([int(v.min(initial=0) < 0)])
                if below[0]:
                    v = _fold(v)
                    v = (np.sort((np.repeat(np.arange(len(n)), n) << 32) | v)) & 0xFFFFFFFF
                if len(mine):
                    yield _messages([(1, i, _packed(node[mine], n, _gaps(v, n), kind[mine] + 1, brand[mine] + 1, below))])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, task = None, None
        for at, role, _, arrays in _told(batches):
            if at != last:
                last, task = at, _Ends(at % ends == 0)
            if role == 0:
                task.add(*arrays)
            else:
                yield from task.reached(*arrays)

    parts = near.mapInArrow(packed, "role int, block int, data binary")
    at = F.when(F.col("role") == 0, F.transform(F.sequence(F.lit(0), F.lit(starts - 1)), lambda i: i * ends + F.col("block"))).otherwise(F.transform(F.sequence(F.lit(0), F.lit(ends - 1)), lambda j: F.col("block") * ends + j))
    found = _sent(parts, at, starts * ends).mapInArrow(met, f"node int, {', '.join(f'{c} long' for c in REACHED)}")
    return found.groupBy("node").agg(*(F.sum(c).alias(c) for c in REACHED))


class _Ends:
    """The lists of all nodes as far as one block of ends goes, and what the ends are."""

    def __init__(self, first: bool) -> None:
        self.first, self.near, self.kinds, self.parts, self.last, self.ready = first, _Lists(), _Lists(), [], None, False

    def add(self, node: np.ndarray, lens: np.ndarray, gaps: np.ndarray, klens: np.ndarray, kinds: np.ndarray, place: np.ndarray, kind: np.ndarray, brand: np.ndarray) -> None:
        some, kinded = lens > 0, klens > 0
        self.near.add(node[some], lens[some], _values(gaps, lens))
        self.kinds.add(node[kinded], klens[kinded], kinds)
        self.parts.append((place, kind - 1, brand - 1))

    def end(self) -> None:
        self.near.end()
        self.kinds.end()
        size = max([int(self.near.values.max(initial=-1)) + 1, *(int(p.max()) + 1 for p, _, _ in self.parts if len(p))])
        self.kind, self.brand = np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        for place, kind, brand in self.parts:
            self.kind[place], self.brand[place] = kind, brand
        self.typed = np.zeros(len(self.near.len), np.int64)
        rows = np.flatnonzero(self.near.len)
        for some in _pieces(self.near.len[rows], PATHS):
            k = rows[some]
            n = self.near.len[k]
            self.typed[k] = np.add.reduceat((self.kind[self.near.values[_runs(self.near.start[k], n)]] >= 0).astype(np.int64), np.cumsum(n) - n)
        self.ready = True

    def different(self, lists: _Lists, of: np.ndarray, place: np.ndarray, count: int, sums: list[np.ndarray] = (), kind: np.ndarray | None = None, brand: np.ndarray | None = None) -> np.ndarray:
        """How many different values the lists at `place` have together, for each of `count` nodes; also adds to sums how often values are of the node's kind, brand and both."""
        out, n = np.zeros(count, np.int64), lists.lens(place)
        of, place, n = of[n > 0], place[n > 0], n[n > 0]
        if not len(of):
            return out
        size = int(lists.values.max()) + 1
        each = np.bincount(of, n, count).astype(np.int64)
        for nodes in _pieces(each, PATHS, max(1, (1 << 24) // size)):
            low, high = np.searchsorted(of, [nodes.start, nodes.stop])
            if low == high:
                continue
            alone = nodes.stop - nodes.start == 1 and each[nodes.start] > PATHS  # looked at piece by piece
            if alone:
                seen = np.zeros(size, bool)
            elif self.last is None or len(self.last) < size * (nodes.stop - nodes.start):
                self.last = np.zeros(size * (nodes.stop - nodes.start), np.int32)
            for piece in _pieces(n[low:high], PATHS) if alone else [slice(0, high - low)]:
                p, m, o = place[low:high][piece], n[low:high][piece], of[low:high][piece]
                values = lists.values[_runs(lists.start[p], m)]
                by = np.repeat(o, m)
                if alone:
                    seen[values] = True
                else:
                    at, k = (by - nodes.start) * size + values, np.arange(len(values), dtype=np.int32)
                    self.last[at] = k  # of equal ones the last stays
                    out[nodes] += np.bincount(by[self.last[at] == k] - nodes.start, minlength=nodes.stop - nodes.start)
                if sums:
                    same, alike = self.kind[values] == kind[by], self.brand[values] == brand[by]
                    for total, flag in zip(sums, (same, alike, same & alike), strict=True):
                        total[nodes] += np.bincount(by[flag] - nodes.start, minlength=nodes.stop - nodes.start)
            if alone:
                out[nodes.start] = np.count_nonzero(seen)
        return out

    def reached(self, node: np.ndarray, lens: np.ndarray, gaps: np.ndarray, kind: np.ndarray, brand: np.ndarray, below: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not self.ready:
            self.end()
        via, count = _values(gaps, lens), len(node)
        if not below[0]:
            via = _fold(via)
        of = np.repeat(np.arange(count), lens)
        none = lambda x: np.where(x > 0, x - 1, -2)  # noqa: E731  none is like nothing, not even like none
        sums = [np.zeros(count, np.int64) for _ in range(3)]
        size = self.different(self.near, of, via, count, sums, none(kind), none(brand))
        types = self.different(self.kinds, of, via, count)
        n = self.near.lens(via)
        others = np.bincount(of, n, count).astype(np.int64)
        typed = np.bincount(of, np.where(n > 0, self.typed[np.where(n > 0, via, 0)], 0) if len(self.typed) else n, count).astype(np.int64)
        columns = [size, types, lens if self.first else np.zeros(count, np.int64), others, typed, *sums]
        yield pa.RecordBatch.from_arrays([pa.array(node, pa.int32()), *(pa.array(c, pa.int64()) for c in columns)], ["node", *REACHED])




def _of_edges(edges: DataFrame, rows: int) -> tuple[DataFrame, DataFrame]:
    """(nodes with numbers, edges with numbers src_number and dst_number)."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("told")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("told")))).alias("e")).select("e.*")
    nodes = numbered(ends.groupBy("node").agg(F.count("*").alias("n"), F.max("told").alias("told")), "node", rows, F.col("n")).select("node", "number", "told")
    side = lambda s: nodes.select(F.col("node").alias(s), F.when(F.col("told") == 1, F.col("number")).otherwise(-1 - F.col("number")).alias(f"{s}_number"))
    return nodes, edges.select("src", "dst").join(side("src"), "src").join(side("dst"), "dst")


def reached(edges: DataFrame, rows: int) -> DataFrame:
    """(node, size): how many other nodes can be reached over two edges (src, dst), of which each is there both ways, or only from `src` for nodes that aren't to be told. rows: about their number."""
    nodes, e = _of_edges(edges, rows)
    both = F.explode(F.array(F.struct(F.col("src_number").alias("node"), F.array("dst_number").alias("near")), F.struct(F.col("dst_number").alias("node"), F.array("src_number").alias("near"))))
    near = lists(e.select(both.alias("e")).select("e.*"), 2 * rows)
    none = F.lit(-1)
    found = paths(near.select("node", none.alias("kind"), none.alias("brand"), "near", F.lit([]).cast("array<int>").alias("kinds")), rows).where("size > 1")
    return found.join(nodes.where("told = 1").select(F.col("node").alias("_id"), F.col("number").alias("node")), "node").select(F.col("_id").alias("node"), (F.col("size") - 1).alias("size"))


def connected(edges: DataFrame, rows: int) -> DataFrame:
    """(node, connected): how many ordered pairs of a node's neighbours have an edge between them; each edge (src, dst) is there both ways, once. rows: about their number."""
    nodes, e = _of_edges(edges, rows)
    up = e.where("src_number < dst_number").select(F.col("src_number").alias("node"), F.array("dst_number").alias("near"))
    found = triangles(lists(up, rows), rows // 2).where("connected > 0")
    return found.join(nodes.select(F.col("node").alias("_id"), F.col("number").alias("node")), "node").select(F.col("_id").alias("node"), "connected")
