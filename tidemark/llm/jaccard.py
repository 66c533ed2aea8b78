"""Documents whose sets of word shingles have a Jaccard similarity of a bound or more, joined by count vectors in an R-tree.

Each shingle is hashed to a group; a set is a point that has the count of its shingles in each group. The overlap of two sets
is at most the sum over the groups of the smaller count, and the overlap of a set with any set below a node of an R-tree over
such points is at most the sum of minima with the node's maxima. Pairs that survive are verified on the sets.

To bring points together that can survive, without comparing all with all:

1. Documents with equal sets are one point from here on.
2. Sets are cut by hash into windows of about WINDOW shingles. If two sets are similar enough, so are their parts in one window at least,
   since the whole overlap is at most as large a share of the whole union as in the best window.
   Such parts differ in few shingles, `most_apart` at most. A window is cut by hash into more
   pieces than that (see pieces()); each differing shingle spoils one piece, so that one of the first
   most_apart + 1 pieces that aren't empty is the same in both sets. The pieces that occur twice are found
   first; the points that share one go to one task with the window's counts, and the R-tree bound leaves links between candidates. Counts of
   a window tell sets of any size apart; those of all of a long set would be alike for unrelated sets.
3. Documents that such links connect come together with their texts, which are read again; an R-tree over finer counts gives
   candidates and the sets decide, by their hashes first and then by the shingles themselves. Points that are already connected needn't be verified against each other.

Pieces and groups of candidates with many points are dealt out in chunks, and each pair of chunks is a task of its own. What
tasks return are forests of links, never all pairs.

Defined results: a null or wordless text has an empty set and links with nothing; fewer words than a shingle are one shingle;
rows with the same id and equal sets are one document, those with different sets are documents that share a number; a null id links with nothing; extra columns are not used; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import blocks, words
from tidemark.llm.shared import components, dropped, saved, sifted

#: Groups of the count vectors with which points meet, and of those within a group of candidates.
GROUPS, FINE = 128, 256
#: Shingles of a window, a power of two: a set of a class of sizes has between this and twice as many in each of its windows, on average.
WINDOW = 512
#: Points that share a piece, and documents of a group of candidates, that one task compares on one side.
CHUNK, DOCS = 512, 512
#: Shingles of those documents, on average.
SHINGLES = 1 << 22
#: Sets below this size are cut into single shingles.
TINY = 32
LEAF = 32
#: Bytes of text whose shingles are held at once.
PART = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def shingle_sets(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the distinct shingles of each text in order, number of them in each text)."""
    low = words.lower(data)
    begin, end, text = words.spans(~_SPACE[low], at)
    word = words.hashes(low, begin, end)
    count = len(at) - 1
    n, first = words.place(text, count)
    # of each text n - size + 1 shingles, one if it has fewer words, none without words
    many = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    cut = np.append(0, np.cumsum(many))
    start = np.repeat(first - cut[:-1], many) + np.arange(cut[-1])
    length = np.repeat(np.minimum(n, size), many)
    value = np.zeros(len(start), np.uint64)
    for k in range(size):
        here = k < length
        value = np.where(here, words.mix(value * np.uint64(0x9E3779B97F4A7C15) + word[np.minimum(start + k, max(len(word) - 1, 0))]), value) if len(word) else value
    value ^= length.astype(np.uint64)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        if b - a > 1:
            value[a:b].sort()
    doc = np.repeat(np.arange(count), many)
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    return value[keep], np.bincount(doc[keep], minlength=count)


def most_apart(size: np.ndarray, percent: int) -> np.ndarray:
    """Shingles that a set of that size and a similar one have apart, at most: A + B - 2 I with (100 + p) I >= p (A + B), p B <= 100 A."""
    size = size.astype(np.int64)
    return (100 - percent) * (size + 100 * size // percent) // (100 + percent)


def pieces(flat: np.ndarray, size: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, set) of the pieces of all windows of each set, as windowed_pieces() has them."""
    found = list(windowed_pieces(flat, size, percent))
    return (np.concatenate([x[0] for x in found]), np.concatenate([x[3][x[1]] for x in found])) if found else (np.empty(0, np.uint64), np.empty(0, np.int64))


def windowed_pieces(flat: np.ndarray, size: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(hash and part of each piece; shingles, set and size of each part): parts of sets are windows that aren't empty, pieces the first most_apart + 1 of a part that aren't empty.

    Windows and their pieces are ranges of hashes, as many as fit the class of the set's size (a power of two), so that those of two sets
    of a class can be compared; a set that may be similar to one of the next class is cut for that class too. A
    class has about a quarter more pieces than the largest of its sets needs. Should a part still have too few that aren't empty,
    two such parts might have all of them apart; then the n - ceil(n * percent / 100) + 1 least hashes are given as well, of which
    two similar parts share one. Sets below TINY are cut into single shingles.
    """
    first = np.cumsum(size) - size
    own = np.maximum(np.int64(np.log2(TINY)) - 1, np.log2(np.maximum(size, 1)).astype(np.int64))
    for shift in (0, 1):
        chosen = size > 0 if shift == 0 else (size > 0) & (100 * size // percent >= 2 << own)
        some = np.flatnonzero(chosen)
        if not len(some):
            continue
        whole = size[some]
        at = np.repeat(first[some] - (np.cumsum(whole) - whole), whole) + np.arange(whole.sum())
        h, of, c = flat[at], np.repeat(np.arange(len(some)), whole), np.repeat(own[some] + shift, whole)
        halvings = np.maximum(c - int(np.log2(WINDOW)), 0).astype(np.uint64)
        window = np.where(halvings > 0, h >> (np.uint64(64) - np.maximum(halvings, np.uint64(1))), np.uint64(0))
        new = np.ones(len(h), bool)
        new[1:] = (window[1:] != window[:-1]) | (of[1:] != of[:-1])
        begin = np.flatnonzero(new)
        n, part = np.diff(np.append(begin, len(h))), np.cumsum(new) - 1
        count = (0.45 * percent_room(percent) * (1 << np.minimum(c, int(np.log2(WINDOW))))).astype(np.uint64) + np.uint64(4)
        tiny = c < np.log2(TINY)
        piece = np.where(tiny, h, ((h << halvings) >> np.uint64(32)) * count >> np.uint64(32))
        salt = words.mix(c.astype(np.uint64) * np.uint64(0x165667B19E3779F9) + window * np.uint64(0x9E3779B185EBCA87))
        new[1:] |= piece[1:] != piece[:-1]
        start = np.flatnonzero(new)
        sums, owner = np.add.reduceat(words.mix(h), start), part[start]
        rank = np.arange(len(start)) - np.searchsorted(owner, owner)
        keep = rank <= most_apart(n, percent)[owner]
        value = words.mix(sums + piece[start] * np.uint64(0xC2B2AE3D27D4EB4F) + salt[start])
        few = np.bincount(owner, minlength=len(n)) <= most_apart(n, percent)
        prefix = n + (-n * percent) // 100 + 1
        least = few[part] & (np.arange(len(h)) - begin[part] < prefix[part])
        least_value = words.mix((h[least] ^ salt[least]) + np.uint64(0x27D4EB2F165667C5))
        yield np.concatenate([value[keep], least_value]), np.concatenate([owner[keep], part[least]]), h, some[of[begin]], n


def percent_room(percent: int) -> float:
    """The pieces that a set needs for each shingle, against those at 85 percent."""
    return float(most_apart(np.array([1_000_000]), percent)[0]) / 176_470


def count_vectors(flat: np.ndarray, size: np.ndarray, groups: int) -> np.ndarray:
    """A row of counts for each set."""
    of = np.repeat(np.arange(len(size)), size)
    at = of * groups + (flat & np.uint64(groups - 1)).astype(np.int64)
    return np.bincount(at, minlength=len(size) * groups).reshape(len(size), groups)


def narrowed(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes; the rows that don't fit get 255 everywhere, which stands for no bound."""
    return np.where(counts.max(1, initial=0)[:, None] >= 255, 255, counts).astype(np.uint8)


def widened(counts: np.ndarray) -> np.ndarray:
    return np.where((counts == 255).all(1)[:, None], 1 << 20, counts.astype(np.int32))


class Tree:
    """An R-tree over count vectors, packed by halving along the coordinate with the widest range."""

    def __init__(self, counts: np.ndarray, size: np.ndarray, percent: int):
        self.counts, self.size, self.percent = counts.astype(np.int32), size.astype(np.int64), percent
        todo, leaves = [np.arange(len(size))], []
        while todo:
            part = todo.pop()
            if len(part) <= LEAF:
                leaves.append(part)
                continue
            wide = int(np.ptp(self.counts[part], axis=0).argmax())
            half = part[np.argsort(self.counts[part, wide], kind="stable")]
            todo += [half[len(half) // 2 :], half[: len(half) // 2]]
        self.leaves = leaves
        # each level has the maxima and the smallest size of the nodes of the one below
        self.levels = [(np.stack([self.counts[x].max(0) for x in leaves]), np.array([self.size[x].min() for x in leaves]))]
        while len(self.levels[-1][0]) > LEAF:
            top, least = self.levels[-1]
            at = np.arange(0, len(top), LEAF)
            self.levels.append((np.maximum.reduceat(top, at), np.minimum.reduceat(least, at)))

    def may(self, counts: np.ndarray, size: int, others: np.ndarray, least: np.ndarray) -> np.ndarray:
        overlap = np.minimum(others, counts).sum(1, dtype=np.int64)
        return (100 + self.percent) * overlap >= self.percent * (size + least)

    def near(self, k: int) -> np.ndarray:
        """The points, in order, that the bound doesn't rule out for point k; k itself among them."""
        counts, size = self.counts[k], int(self.size[k])
        nodes = None
        for level in range(len(self.levels) - 1, -1, -1):
            top, least = self.levels[level]
            nodes = np.arange(len(top)) if nodes is None else (nodes[:, None] * LEAF + np.arange(LEAF)).ravel()
            nodes = nodes[nodes < len(top)]
            nodes = nodes[self.may(counts, size, top[nodes], least[nodes])]
        if not len(nodes):
            return np.empty(0, np.int64)
        points = np.sort(np.concatenate([self.leaves[n] for n in nodes]))
        return points[self.may(counts, size, self.counts[points], self.size[points])]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if len(a) > len(b):
        a, b = b, a
    if 100 * len(a) < percent * len(b):
        return False
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def surely_similar(a: str, b: str, size: int, percent: int) -> bool:
    """Whether two texts reach the similarity by their shingles themselves."""
    cut = [re.findall(rb"[^\x20\x09-\x0D]+", t.encode().lower()) for t in (a, b)]
    x, y = ({tuple(w[k : k + size]) for k in range(max(len(w) - size, 0) + 1)} for w in cut)
    return 100 * len(x & y) >= percent * len(x | y)


def forest(tree: Tree, sides: np.ndarray | None, verify=None) -> tuple[np.ndarray, np.ndarray]:
    """(point, root) of the points that links connect with others; links join the two sides if there are sides.

    Without verify the bound alone makes a link; else pairs are verified whose points aren't connected yet.
    """
    root = np.arange(len(tree.size))
    for k in range(len(root)):
        near = tree.near(k)
        near = near[near > k] if sides is None else near[(near > k) & (sides[near] != sides[k])]
        if verify is None:
            near = near[root[near] != root[k]]
            if len(near):
                joined = np.isin(root, root[near]) | (root == root[k])
                root[joined] = root[joined].min()
            continue
        while len(near := near[root[near] != root[k]]):
            if verify(k, int(near[0])):
                joined = (root == root[k]) | (root == root[near[0]])
                root[joined] = root[joined].min()
            near = near[1:]
    alone = np.bincount(root, minlength=len(root)) < 2
    some = np.flatnonzero(~alone[root])
    return some, root[some]


def _candidates(t: pa.Table, begins: np.ndarray, percent: int) -> pa.Table:
    """Links between candidates in runs of points that share a piece."""
    key = t.column("own").to_numpy()
    ends = np.append(begins[1:], len(t))
    ids, size = t.column("i").to_numpy(), t.column("n").to_numpy()
    counts = widened(np.frombuffer(b"".join(t.column("counts").to_pylist()), np.uint8).reshape(-1, GROUPS))
    links = []
    run = np.repeat(np.arange(len(begins)), ends - begins)
    length = ends - begins
    cross = t.column("c1").to_numpy() != t.column("c2").to_numpy()
    # short runs together, by the distance of the two rows; long ones with a tree each
    short = length[run] <= LEAF
    for d in range(1, LEAF):
        a = np.flatnonzero(short[:-d] & short[d:] & (run[:-d] == run[d:])) if len(t) > d else np.empty(0, np.int64)
        if not len(a):
            break
        b = a + d
        a, b = (x[~cross[a] | (key[a] != key[b])] for x in (a, b))
        overlap = np.minimum(counts[a], counts[b]).sum(1, dtype=np.int64)
        good = (100 + percent) * overlap >= percent * (size[a].astype(np.int64) + size[b])
        links.append(np.stack([ids[a[good]], ids[b[good]]]))
    for k in np.flatnonzero(length > LEAF):
        rows = slice(begins[k], ends[k])
        tree = Tree(counts[rows], size[rows], percent)
        some, root = forest(tree, key[rows] if cross[begins[k]] else None)
        links.append(np.stack([ids[rows][some], ids[rows][root]]))
    links = np.concatenate(links, 1) if links else np.empty((2, 0), np.int64)
    links = np.stack([links.max(0), links.min(0)])
    links = np.unique(links[:, links[0] != links[1]], axis=1)
    return pa.table({"a": pa.array(links[0], pa.int64()), "b": pa.array(links[1], pa.int64())})


def _verified(t: pa.Table, begins: np.ndarray, percent: int, shingle: int) -> pa.Table:
    """The forest of true links of each run of documents, which are a group of candidates or a pair of its chunks."""
    ids, own = t.column("i").to_numpy(), t.column("own").to_numpy()
    cross = (t.column("c1").to_numpy() != t.column("c2").to_numpy()) | (t.column("l1").to_numpy() != t.column("l2").to_numpy())
    a, b = [], []
    for begin, end in zip(begins, np.append(begins[1:], len(t)), strict=True):
        if end - begin < 2:
            continue
        flat, size = [], []
        for _, data, at in words.parts(t.column("text").slice(begin, end - begin), PART):
            f, n = shingle_sets(data, at, shingle)
            flat.append(f)
            size.append(n)
        flat, size = np.concatenate(flat), np.concatenate(size)
        cut = np.append(0, np.cumsum(size))
        tree = Tree(count_vectors(flat, size, FINE), size, percent)
        texts = t.column("text").slice(begin, end - begin)

        def linked(x: int, y: int, flat=flat, cut=cut, texts=texts) -> bool:
            return similar(flat[cut[x] : cut[x + 1]], flat[cut[y] : cut[y + 1]], percent) and surely_similar(texts[x].as_py(), texts[y].as_py(), shingle, percent)

        some, root = forest(tree, own[begin:end] if cross[begin] else None, linked)
        a.append(ids[begin:end][some])
        b.append(ids[begin:end][root])
    return pa.table({"a": np.concatenate(a) if a else np.empty(0, np.int64), "b": np.concatenate(b) if b else np.empty(0, np.int64)})


def _chunk(ids: np.ndarray, chunks: np.ndarray) -> np.ndarray:
    return (words.mix(ids.astype(np.uint64) + np.uint64(77)) % np.maximum(chunks, 1).astype(np.uint64)).astype(np.int64)


def set_digests(texts: pa.ChunkedArray | pa.Array, shingle: int) -> tuple[np.ndarray, list[bytes | None]]:
    """The size and a digest of the set of each text; an empty set has no digest."""
    sizes, keys = [np.empty(0, np.int64)], []
    for _, data, at in words.parts(texts, PART):
        flat, size = shingle_sets(data, at, shingle)
        cut = np.append(0, np.cumsum(size))
        sizes.append(size)
        keys += [hashlib.blake2b(flat[a:b].tobytes(), digest_size=16).digest() if b > a else None for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return np.concatenate(sizes), keys


def profiles(df: DataFrame, id: str, text: str, shingle: int) -> DataFrame:
    """(i, n, key): the size of each document's set and a digest of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, keys = set_digests(batch.column(1), shingle)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary())], names=["i", "n", "key"])

    return df.select(F.col(id).cast("long"), text).mapInArrow(words.trimmed(run), "i long, n long, key binary")


def keyed(df: DataFrame, shingle: int) -> DataFrame:
    """(i, key, text) of each row of df (i, text): with the digest of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = set_digests(batch.column(1), shingle)[1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1)], names=["i", "key", "text"])

    return df.select("i", "text").mapInArrow(words.trimmed(run), "i long, key binary, text string")


def _nodes(t: pa.Table, most: int, shingle: int) -> np.ndarray:
    """The node of each row: its id times `most`, plus the place of its set among the sets of its id, by digest. All rows of an id are here.

    A row with an empty set has no node of its own and gets the least number, which isn't one.
    """
    ids = t.column("i").to_numpy()
    _, back, times = np.unique(ids, return_inverse=True, return_counts=True)
    out, again = ids * most, np.flatnonzero(times[back] > 1)
    if most == 1 or not len(again):
        return out
    _, keys = set_digests(t.column("text").take(pa.array(again)), shingle)
    sets: dict[int, set[bytes]] = {}
    for i, key in zip(ids[again], keys, strict=True):
        sets.setdefault(i, set()).add(key)
    place = {i: {key: n for n, key in enumerate(sorted(x for x in found if x is not None))} for i, found in sets.items()}
    out[again] = [np.iinfo(np.int64).min if key is None else i * most + place[i][key] for i, key in zip(ids[again], keys, strict=True)]
    return out


def _dealt(member: DataFrame, percent: int) -> DataFrame:
    """(component, l1, l2, c1, c2, own, i): the tasks that each document of a group of candidates goes to.

    A group of at most DOCS documents and SHINGLES shingles is one task. A larger one is cut by levels of size, so that similar documents are in the same
    level or in neighbouring ones, and each level in chunks; each pair of chunks that may hold a link is a task.
    """
    share = F.greatest(F.count("*") / DOCS, F.sum("n") / SHINGLES)
    total = member.groupBy("component").agg(share.alias("total"))
    level = F.when(F.col("total") <= 1, 0).otherwise(F.floor(F.log("n") / F.log(F.lit(100 / percent))))
    member = member.join(total, "component").withColumn("level", level.cast("long"))
    chunks = member.groupBy("component", "level").agg(F.ceil(share).alias("chunks"))
    member = member.join(chunks, ["component", "level"]).withColumn("mine", F.pmod(F.xxhash64("i"), "chunks")).withColumn("own", F.col("level") * (1 << 32) + F.col("mine"))
    low, high = (chunks.select("component", (F.col("level") + d).alias("level"), F.col("chunks").alias(name)) for d, name in ((1, "below"), (-1, "above")))
    member = member.join(low, ["component", "level"], "left").join(high, ["component", "level"], "left")
    to = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    at = lambda l1, l2, c1, c2: F.struct(l1.alias("l1"), l2.alias("l2"), c1.alias("c1"), c2.alias("c2"))
    here, mine = F.col("level"), F.col("mine")
    tasks = F.concat(
        F.transform(to(F.col("chunks")), lambda k: at(here, here, F.least(mine, k), F.greatest(mine, k))),
        F.transform(to(F.coalesce("below", F.lit(0))), lambda k: at(here - 1, here, k, mine)),
        F.transform(to(F.coalesce("above", F.lit(0))), lambda k: at(here, here + 1, mine, k)),
    )
    return member.select("i", "component", "own", F.explode(tasks).alias("t")).select("component", "t.*", "own", "i")


def find(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 4, percent: int = 85) -> DataFrame:
    """(id, n_shingles, component_id) of each row.

    Rows of one id with different sets are documents of their own that share its number. A document's node is its id times the largest number of
    sets that an id has (one, where ids don't repeat), plus a place; if that overflows, the job fails.
    """
    known = saved(profiles(df, id, text, shingle), "profiles")
    docs, size = blocks.batched(df.where(F.col(id).isNotNull()), id, text)
    count = max(1, -(-size // blocks.BATCH))
    real = known.where("n > 0 AND i IS NOT NULL")
    most = real.groupBy("i").agg(F.count_distinct("key").alias("sets")).agg(F.max("sets")).first()[0] or 1
    place = F.lit(0) if most == 1 else F.dense_rank().over(Window.partitionBy("i").orderBy("key")) - 1
    real = real.select("i", "n", "key", (F.col("i") * F.lit(most).cast("long") + place).alias("node"))
    least = real.groupBy("key").agg(F.min(F.struct("node", "i")).alias("x")).select("key", "x.node", "x.i")
    one = least.select(blocks.batch_of("i", count).alias("batch"), F.col("node").alias("i"), F.lit(None).cast("long").alias("hash"), F.lit(None).cast("int").alias("count"))

    def chosen(t: pa.Table, nodes: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(nodes, hashes, sizes) of the chosen documents, once each, in parts."""
        want = np.unique(np.array([x for x in nodes.to_pylist() if x is not None], np.int64))
        t = t.set_column(t.schema.get_field_index("i"), "i", pa.array(_nodes(t, most, shingle)))
        have, at = np.unique(t.column("i").to_numpy(), return_index=True)
        at = np.sort(at[np.isin(have, want)])
        t = t.select(["i", "text"]).take(pa.array(at)).combine_chunks()
        for k, data, begins in words.parts(t.column("text"), PART):
            flat, n = shingle_sets(data, begins, shingle)
            yield t.column("i").to_numpy()[k : k + len(n)], flat, n

    def asking(docs: pa.Table, ones: pa.Table) -> pa.Table:
        got = [pieces(flat, n, percent)[0] for _, flat, n in chosen(docs, ones.column("i"))] if len(docs) else []
        return blocks.ask(docs.column("batch")[0].as_py() if len(docs) else 0, np.concatenate([np.empty(0, np.uint64), *got]))

    def emitting(docs: pa.Table, asked: pa.Table) -> pa.Table:
        answer, out = blocks.answers(asked), []
        for ids, flat, n in chosen(docs, asked.column("i")) if len(docs) else ():
            for value, of, shingles, whole, size in windowed_pieces(flat, n, percent):
                times = blocks.known(value, answer)
                value, of, times = value[times > 1], of[times > 1], times[times > 1]
                chunks = -(-times // CHUNK)
                own = _chunk(ids[whole[of]], chunks)
                again = np.repeat(np.arange(len(of)), chunks)
                other = np.arange(len(again)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
                vec = narrowed(count_vectors(shingles, size, GROUPS))
                out.append(pa.table({
                    "piece": value[again].view(np.int64), "c1": np.minimum(own[again], other), "c2": np.maximum(own[again], other), "own": own[again], "i": ids[whole[of[again]]],
                    "n": size[of[again]], "counts": pa.array([vec[k].tobytes() for k in of[again]], pa.binary()),
                }))
        return pa.concat_tables([x.combine_chunks() for x in out]) if out else _ROWS.empty_table()

    by = docs.groupBy("batch")
    asked = by.cogroup(one.groupBy("batch")).applyInArrow(asking, blocks.ASKED)
    replies = blocks.repeated(asked).select("batch", F.lit(None).cast("long").alias("i"), "hash", "count").unionAll(one)
    rows = by.cogroup(replies.groupBy("batch")).applyInArrow(emitting, "piece long, c1 long, c2 long, own long, i long, n long, counts binary")
    found = saved(blocks.in_runs(rows, ["piece", "c1", "c2"], lambda t, b: _candidates(t, b, percent), "a long, b long"), "candidates")

    groups = components(found)
    dropped(found)
    member = _dealt(groups.withColumnRenamed("node", "i").join(real.select(F.col("node").alias("i"), "n").distinct(), "i"), percent)
    # the texts of the candidates, read again and taken once for each set of an id
    named = real.select("i", "key", "node").distinct().join(groups.select("node"), "node")
    again = sifted(df.select(F.col(id).cast("long").alias("i"), F.col(text).alias("text")), named, "i").where("_maybe")
    texts = keyed(again, shingle).join(named, ["i", "key"]).select(F.col("node").alias("i"), "text").dropDuplicates(["i"]).join(member, "i")
    links = blocks.in_runs(texts.select("component", "l1", "l2", "c1", "c2", "own", "i", "text"), ["component", "l1", "l2", "c1", "c2"], lambda t, b: _verified(t, b, percent, shingle), "a long, b long", rows=1500)
    parts = components(links)

    # equal sets share the component of the least node among them, and a component is told by the id of its least node
    least = least.drop("i").join(parts.withColumnRenamed("node", "at"), F.col("node") == F.col("at"), "left")
    least = least.select("key", F.coalesce("component", "node").alias("x")).select("key", F.expr(f"(x - pmod(x, {most}L)) div {most}L").alias("component"))
    same = known.join(least, "key", "left").select("i", "n", F.when(F.col("i").isNotNull(), F.coalesce("component", "i")).alias("component_id"))
    done = saved(same.select(F.col("i").alias(id), F.col("n").alias("n_shingles"), "component_id"), "jaccard")
    for table in (known, groups, parts):
        dropped(table)
    return done


_ROWS = pa.schema([("piece", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("own", pa.int64()), ("i", pa.int64()), ("n", pa.int64()), ("counts", pa.binary())])
