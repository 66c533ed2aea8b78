"""Neighbourhoods of a directed graph given as edges (src, dst) with columns of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_edges(edges: DataFrame, most: int) -> DataFrame:
    """The `most` heaviest edges (src, dst, n) of each node, by n descending, then dst; it bounds what two hops can give."""
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return edges.withColumn("_r", rank).where(F.col("_r") <= most).drop("_r")


def one_hop(edges: DataFrame, nodes: DataFrame, id: str, columns: Sequence[str]) -> DataFrame:
    """edges with the columns of both ends, prefixed src_ and dst_."""
    side = lambda s: nodes.select(F.col(id).alias(s), *(F.col(c).alias(f"{s}_{c}") for c in columns))
    return edges.join(side("src"), "src").join(side("dst"), "dst")


def two_hops(edges: DataFrame, sources: Column | None = None) -> DataFrame:
    """(src, via, dst): paths of two edges that don't return to their start; with `sources`, a condition on src, only those of some nodes, over all edges."""
    e = edges.select("src", "dst")
    first = (e if sources is None else e.where(sources)).withColumnRenamed("dst", "via")
    return first.join(e.withColumnRenamed("src", "via"), "via").where("src != dst").select("src", "via", "dst")


def exclusive_two_hops(edges: DataFrame) -> DataFrame:
    """(src, dst): nodes at two hops that aren't at one."""
    return two_hops(edges).select("src", "dst").distinct().join(edges.select("src", "dst"), ["src", "dst"], "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """(node, out_degree, in_degree, magnet): magnet is in - out, null for a node that lacks either."""
    at = lambda node, out, into: F.struct(F.col(node).alias("node"), F.lit(out).alias("o"), F.lit(into).alias("i"))
    ends = edges.select(F.explode(F.array(at("src", 1, 0), at("dst", 0, 1))).alias("x")).groupBy("x.node").agg(*(F.nullif(F.sum(f"x.{c}"), F.lit(0).cast("long")).alias(n) for c, n in (("o", "out_degree"), ("i", "in_degree"))))
    return ends.withColumn("magnet", F.col("in_degree") - F.col("out_degree"))


def triangles(edges: DataFrame) -> DataFrame:
    """(u, v, w, uv, vu, uw, wu, vw, wv): each three nodes with an edge between any two, once, and which of their six directed edges there are (0 or 1).

    Each pair of nodes belongs to the one with fewer neighbours, so a node of any degree has at most sqrt(2 * pairs) of its
    own, and what is joined is bounded by pairs ** 1.5 however large the hubs are.
    """
    e = edges.where("src != dst").select("src", "dst").distinct()
    low, high = F.least("src", "dst"), F.greatest("src", "dst")
    up = F.max((F.col("src") < F.col("dst")).cast("int"))
    pairs = e.groupBy(low.alias("a"), high.alias("b")).agg(up.alias("ab"), F.max((F.col("src") > F.col("dst")).cast("int")).alias("ba"))
    degree = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("k"))
    known = pairs.join(degree.toDF("a", "ka"), "a").join(degree.toDF("b", "kb"), "b")
    turn = F.struct("kb", "b") < F.struct(F.col("ka").alias("kb"), F.col("a").alias("b"))
    swap = lambda x, y, name: F.when(turn, F.col(y)).otherwise(F.col(x)).alias(name)
    own = known.select(swap("a", "b", "u"), swap("b", "a", "v"), swap("ab", "ba", "uv"), swap("ba", "ab", "vu"), swap("kb", "ka", "k"))
    other = own.select("u", F.col("v").alias("w"), F.col("uv").alias("uw"), F.col("vu").alias("wu"), F.col("k").alias("kw"))
    wedges = own.join(other, "u").where(F.struct("k", "v") < F.struct(F.col("kw").alias("k"), F.col("w").alias("v"))).drop("k", "kw")
    return wedges.join(own.select(F.col("u").alias("v"), F.col("v").alias("w"), F.col("uv").alias("vw"), F.col("vu").alias("wv")), ["v", "w"])


def clustering(edges: DataFrame) -> DataFrame:
    """(node, pairs, connected): ordered pairs of a node's neighbours, and how many of them an edge connects.

    Pairs are counted from the degree, connected ones from the triangles, each of which is found once and tells all three of its nodes.
    """
    e = edges.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("k"))
    at = lambda node, first, second, there, back: F.struct(F.col(node).alias("node"), (F.col(first) * F.col(second) * (F.col(there) + F.col(back))).alias("n"))
    each = F.array(at("u", "uv", "uw", "vw", "wv"), at("v", "vu", "vw", "uw", "wu"), at("w", "wu", "wv", "uv", "vu"))
    closed = triangles(e).select(F.explode(each).alias("x")).select("x.node", "x.n")
    # a node that is its own neighbour is connected with its other neighbours, and those that point back with it
    own = e.where("src != dst").join(e.where("src = dst").select("src"), "src")
    back = own.join(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(1).alias("n")), ["src", "dst"], "left")
    found = closed.unionAll(back.select("src", 1 + F.coalesce("n", F.lit(0)))).groupBy("node").agg(F.sum("n").alias("connected"))
    pairs = (F.col("k") * (F.col("k") - 1)).alias("pairs")
    return out.join(found, "node", "left").select("node", pairs, F.coalesce("connected", F.lit(0)).alias("connected"))
