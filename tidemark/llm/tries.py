"""A prefix trie of conversations, each node with what sharing its subtree's turns would save.

A node is a distinct sequence of first turns. It is known by its depth and by two 64-bit hashes, each the exclusive or of
hashes of (depth, turn) over the sequence, so that a prefix of any length is a running value and no sequence is ever held.
The smallest conversation through a node owns it. If a conversation owns a node, it owns all nodes after it on
its path, so each conversation owns a suffix of its path, and each node has one owner: owners are found by a group-by, joined back with frequent nodes
dealt out over tasks, and windows along each path mark the owned nodes. Then one group-by over the nodes of all paths sums,
for each member, the weight of its turns from the node on less that of those it owns, and whether its last node is a leaf that it owns.

Windows run along pieces of CHUNK turns, whose sums are carried on, so a conversation of any length is many small
windows. The digest of a node's ended conversations reads them one after another, sorted, in bounded memory; being a digest of an
ordered list, it is the work of one task for each node, of one number for each conversation that ends there.

Defined results: rows without a conversation id are left out; turns without a number come first; turns of one number are in the
order of a digest of role and text; a null role or text counts as empty; other columns don't matter;
an empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import saved, spread

#: Turns of a path that one window holds at most, as long as their numbers differ.
CHUNK = 4096
NODE = ["depth", "x", "y"]


def along(df: DataFrame, key: str, at: str, order: list[Column], sums: dict[str, tuple] = {}, lags: dict[str, Column] = {}, leads: dict[str, Column] = {}, back: bool = False) -> DataFrame:  # noqa: B006
    """df with running values along each key: sums {name: (aggregate, value, how to add two)}, and values of the rows before and after.

    Rows are cut by `at` (bigint, the first of `order`) in pieces of CHUNK, whose totals are carried on; with lags or leads, `at` is
    dense and each piece also gets the rows that touch it. `back` makes the sums run from the end.
    """
    piece = F.coalesce(F.floor(F.col(at) / CHUNK), F.lit(-(2**62)))
    rows = df.withColumns({"_c": piece, "_guest": F.lit(0)})
    if lags or leads:
        last, first = F.pmod(F.col(at), F.lit(CHUNK)) == CHUNK - 1, F.pmod(F.col(at), F.lit(CHUNK)) == 0
        at_piece = lambda c, guest: F.struct(c.alias("c"), F.lit(guest).alias("guest"))
        to = F.array_compact(F.array(at_piece(piece, 0), F.when(last, at_piece(piece + 1, 1)), F.when(first, at_piece(piece - 1, 1))))
        rows = df.withColumn("_x", F.explode(to)).withColumns({"_c": F.col("_x.c"), "_guest": F.col("_x.guest")}).drop("_x")
    w = Window.partitionBy(key, "_c").orderBy(*order)
    run = (w if not back else Window.partitionBy(key, "_c").orderBy(F.desc(at))).rowsBetween(Window.unboundedPreceding, 0)
    own = lambda c: F.when(F.col("_guest") == 0, c)
    new = {n: agg(own(c)).over(run) for n, (agg, c, _) in sums.items()} | {n: F.lag(c).over(w) for n, c in lags.items()} | {n: F.lead(c).over(w) for n, c in leads.items()}
    rows = rows.withColumns(new).where("_guest = 0").drop("_guest")
    if not sums:
        return rows.drop("_c")
    pieces = df.withColumn("_c", piece).groupBy(key, "_c").agg(*(agg(c).alias(f"_{n}") for n, (agg, c, _) in sums.items()))
    before = Window.partitionBy(key).orderBy(F.desc("_c") if back else F.asc("_c")).rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(key, "_c", *(agg(F.col(f"_{n}")).over(before).alias(f"_{n}") for n, (agg, _, _) in sums.items()))
    done = rows.join(carried, [key, "_c"])
    return done.withColumns({n: add(F.coalesce(n, F.lit(0)), F.coalesce(f"_{n}", F.lit(0))) for n, (_, _, add) in sums.items()}).drop("_c", *(f"_{n}" for n in sums))


def added(c: Column) -> tuple:
    return F.sum, c, lambda a, b: a + b


def mixed(c: Column) -> tuple:
    return F.bit_xor, c, lambda a, b: a.bitwiseXOR(b)


def numbered(df: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", weight: Column | None = None) -> DataFrame:
    """(conv, place, turn_id, weight): the turns of each conversation from place 1 on, each told by a digest; weight: UTF-8 bytes of the text, or what is given."""
    r, t = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    told = F.unhex(F.md5(F.concat(F.length(r).cast("string"), F.lit(":"), r, t)))
    value = weight if weight is not None else F.octet_length(t)
    turns = df.where(F.col(id).isNotNull()).select(F.col(id).cast("long").alias("conv"), F.col(turn).cast("long").alias("turn"), told.alias("turn_id"), value.cast("long").alias("weight"))
    return along(turns, "conv", "turn", [F.asc_nulls_first("turn"), F.col("turn_id")], {"place": added(F.lit(1).cast("long"))}).drop("turn")


def branched(turns: DataFrame, every: int = 5, head: Column | None = None) -> DataFrame:
    """(conv, place, turn_id, weight): conversations that begin with the first h turns of conversation conv - conv % every, then go on with their own after the first h.

    h: crc32 of the id modulo 9 unless `head`, a column of `conv` below 9, is given; turns: as `numbered` has them. A conversation that is left without a turn has one row with place 0.
    """
    h = head if head is not None else F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(9))
    convs = turns.select("conv").distinct()
    near = F.array(*(F.try_add(F.col("base"), F.lit(k)) for k in range(1 - every, every)))
    heads = turns.where("place < 9").withColumnRenamed("conv", "base").withColumn("conv", F.explode(near))
    heads = heads.where((F.col("conv") - F.col("conv") % every == F.col("base")) & (F.col("place") <= h)).join(convs, "conv", "left_semi")
    ahead = heads.groupBy("conv").agg(F.count("*").alias("k"))
    own = turns.where(F.col("place") > h).join(ahead, "conv", "left").withColumn("place", F.col("place") - h + F.coalesce("k", F.lit(0)))
    columns = ["conv", "place", "turn_id", "weight"]
    none = convs.select("conv", F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("turn_id"), F.lit(0).cast("long").alias("weight"))
    return heads.select(columns).unionAll(own.select(columns)).unionAll(none)


def _digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of the decimal ids, ascending and joined by commas, read as a stream of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, digest = None, None
        done: list[tuple] = []
        out = lambda: pa.RecordBatch.from_pylist([dict(zip([*NODE, "ends_sha256"], d, strict=True)) for d in done], schema)
        for batch in batches:
            for *key, conv in zip(*(batch.column(c).to_pylist() for c in [*NODE, "conv"]), strict=True):
                if key == node:
                    digest.update(f",{conv}".encode())
                    continue
                if node is not None:
                    done.append((*node, digest.hexdigest()))
                node, digest = key, hashlib.sha256(str(conv).encode())
            if done:
                yield out()
                done.clear()
        if node is not None:
            done.append((*node, digest.hexdigest()))
            yield out()

    schema = pa.schema([*((c, pa.int64()) for c in NODE), ("ends_sha256", pa.string())])
    ends = ends.select(*NODE, "conv").repartition(*NODE).sortWithinPartitions(*NODE, "conv")
    return ends.mapInArrow(run, "depth long, x long, y long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations (conv, place, turn_id, weight), places from 1 on without gaps; rows of place 0 stand for conversations without turns.

    Returns conv_id (the owner), depth, parent_conv_id, n_convs, n_children, n_leaves and saved_tokens of the subtree, and ends_sha256.
    """
    turns = turns.where("place > 0").unionAll(turns.select("conv").distinct().select("conv", F.lit(0).cast("long"), F.lit(None).cast("binary"), F.lit(0).cast("long")))
    told = lambda *c: F.when(F.col("place") > 0, F.xxhash64(*c)).otherwise(0)
    paths = along(turns, "conv", "place", [F.col("place")], {"x": mixed(told("place", "turn_id")), "y": mixed(told("turn_id", "place"))}, leads={"next": F.col("place")})
    paths = saved(paths.select("conv", F.col("place").alias("depth"), "x", "y", "weight", F.col("next").isNull().alias("last")), "paths")
    owners = paths.groupBy(*NODE).agg(F.min("conv").alias("owner"), F.min("last").alias("leaf"), F.count("*").alias("n"))
    marked = spread(paths, owners, NODE, paths.count(), ["conv"])
    mine = F.col("owner") == F.col("conv")
    marked = along(
        marked, "conv", "depth", [F.col("depth")],
        {"shared": added(F.when(mine, 0).otherwise(F.col("weight"))), "leaves": added((mine & F.col("last") & F.col("leaf")).cast("long"))},
        {"parent": F.col("owner")}, {"child": mine}, back=True,
    )
    nodes = marked.groupBy(*NODE).agg(
        F.min("conv").alias("conv_id"), F.min("parent").alias("parent_conv_id"), F.count("*").alias("n_convs"), F.count_if("child").alias("n_children"),
        F.sum("leaves").alias("n_leaves"), F.sum("shared").alias("saved_tokens"),
    )
    ended = nodes.join(_digests(paths.where("last")), NODE, "left")
    none = F.lit(hashlib.sha256(b"").hexdigest())
    return ended.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
