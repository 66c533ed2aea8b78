"""Line dedup: repeated runs of lines are found by a suffix array over line sequences and all but their first copy is deleted.

Each line gets an identity by its content. The suffixes of all documents' sequences of lines are ranked by distributed
prefix doubling: the rank at depth 2 d orders suffixes by their ranks at depth d and, of equal ones, by the rank at depth d of the suffix
that begins d lines later. Suffixes of equal rank at depth d are an interval of the suffix array in which adjacent common
prefixes have d lines or more; a suffix that is alone in its interval agrees with no other on so many lines and is left
out from there on. Doubling goes on until no interval has two suffixes.

In each interval the earliest suffix (smallest id, then line) stays. The others are later copies, d lines long at least, and go. Since the rest of
a copy is one too, the spans of all depths overlap and join to the maximal repeated runs, whatever their length.

A repeat is a run of `run` lines, or a single line of `words` words (blanks plus one). Depths that are no power of two
take one step more: depth `run` combines the deepest rank below it with itself.

A line of each document is a row of fixed size when it is shuffled; intervals are counted before they are shuffled, and the rows of frequent ones
are dealt out over tasks, so that a line which a third of the documents hold doesn't meet in one task.

Defined results: a null text has no lines and stays null; an empty text has one empty line; rows of the same id and text
are one document and are treated alike, rows of the same id and other texts are told apart; extra columns are kept, also those with names that
the operator uses inside; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import dropped, saved, spread

RUN, WORDS = 2, 20
#: Columns that tell a suffix: its document by id and text, and its first line.
PLACE = ["i", "h", "k"]


def line_rows(df: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """(i, h, k, a, b, long): each line with two hashes of its content and whether it is a repeat alone."""
    lines = F.split(F.col(text), "\n", -1)
    blanks = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" ")))
    each = F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(7), x).alias("b"), (blanks(x) + 1 >= words).alias("long")))
    rows = df.where(F.col(text).isNotNull()).select(F.col(id).alias("i"), F.xxhash64(text).alias("h"), F.posexplode(each).alias("k", "x"))
    return rows.select(*PLACE, "x.*")


def ranked(rows: DataFrame, keys: list[str], name: str, *also: Column) -> DataFrame:
    """(keys, n, also, rank) of the keys with two rows or more: ranks rise with the keys, and equal keys have equal ones."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), *also).where("n > 1")
    # rows are in order over partitions and inside them, and so are these ids; writing them down fixes them
    return saved(found.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rank", F.monotonically_increasing_id()), name)


def refined(suffixes: DataFrame, shift: int, total: int) -> DataFrame:
    """(place, r, copy): the ranks of `suffixes` (place, r), refined by the rank of the suffix `shift` lines later, and whether an interval has an earlier suffix; those alone are left out."""
    place = F.struct(*PLACE)
    later = Window.partitionBy("i", "h").orderBy("k").rangeBetween(shift, shift)
    pairs = suffixes.select(*PLACE, "r", F.max("r").over(later).alias("s")).where("s IS NOT NULL")
    classes = ranked(pairs, ["r", "s"], "line-ranks", F.min(place).alias("least"))
    found = spread(pairs, classes, ["r", "s"], total, PLACE)
    found = saved(found.select(*PLACE, F.col("rank").alias("r"), (place != F.col("least")).alias("copy")), "line-suffixes")
    dropped(classes)
    return found


def copies(suffixes: DataFrame, total: int) -> DataFrame:
    """The suffixes (place, r) of each interval but the earliest."""
    place = F.struct(*PLACE)
    first = suffixes.groupBy("r").agg(F.min(place).alias("least"), F.count("*").alias("n"))
    return spread(suffixes, first, ["r"], total, PLACE).where(place != F.col("least"))


def spans(found: DataFrame, depth: int) -> DataFrame:
    """(i, h, first, end): the lines that the copies found at a depth begin with."""
    return found.select("i", "h", F.col("k").alias("first"), (F.col("k") + depth).alias("end"))


def repeats(df: DataFrame, id: str = "doc_id", text: str = "text", run: int = RUN, words: int = WORDS) -> DataFrame:
    """(id, text's hash, runs): the maximal runs of lines, as (first, end), of each document that copies earlier ones.

    Each depth's table says which suffixes are copies, so what joins their spans is one pass over the tables, whatever their number.
    """
    lines = line_rows(df, id, text, words)
    same = ranked(lines, ["a", "b"], "line-identities")
    total = same.agg(F.sum("n")).first()[0] or 0
    suffixes = saved(spread(lines, same, ["a", "b"], total, PLACE).select(*PLACE, F.col("rank").alias("r"), "long"), "line-suffixes")
    found = spans(copies(suffixes if run == 1 else suffixes.where("long"), total), 1)
    tables = [same, suffixes]
    suffixes, depth = suffixes.drop("long"), 1
    while total:
        # a power of two, or the least length of a repeat on the way
        shift = run - depth if depth < run < 2 * depth else depth
        suffixes, depth = refined(suffixes, shift, total), depth + shift
        tables.append(suffixes)
        total = suffixes.count()
        if total and depth >= run:
            found = found.unionAll(spans(suffixes.where("copy"), depth))
    runs = saved(found.groupBy("i", "h").agg(joined(F.array_sort(F.collect_list(F.struct("first", "end")))).alias("runs")), "line-runs")
    for table in tables:
        dropped(table)
    return runs


def joined(spans: Column) -> Column:
    """Sorted spans (first, end) with those that touch or overlap made one."""
    span = lambda a, b: F.struct(a.alias("first"), b.alias("end"))
    none = F.struct(F.array().cast("array<struct<first:int,end:int>>").alias("done"), F.lit(-1).alias("first"), F.lit(-1).alias("end"))

    def add(state: Column, s: Column) -> Column:
        more = F.struct(state["done"].alias("done"), state["first"].alias("first"), F.greatest(state["end"], s["end"]).alias("end"))
        closed = F.when(state["end"] >= 0, F.concat(state["done"], F.array(span(state["first"], state["end"])))).otherwise(state["done"])
        return F.when(s["first"] <= state["end"], more).otherwise(F.struct(closed.alias("done"), s["first"].alias("first"), s["end"].alias("end")))

    return F.aggregate(spans, none, add, lambda state: F.concat(state["done"], F.array(span(state["first"], state["end"]))))


def kept_lines(lines: Column, runs: Column) -> Column:
    """The lines outside the runs, by slicing between them."""
    begins = F.concat(F.array(F.lit(0)), F.transform(runs, lambda r: r["end"]))
    ends = F.concat(F.transform(runs, lambda r: r["first"]), F.array(F.size(lines)))
    between = lambda n: F.flatten(F.zip_with(begins, ends, lambda a, b: F.slice(n, a + 1, b - a)))
    return F.transform(F.array(lines), between)[0]


def dedup(df: DataFrame, id: str = "doc_id", text: str = "text", run: int = RUN, words: int = WORDS, out: str = "removed_runs") -> DataFrame:
    """df with the text's repeated lines deleted and the runs of deleted lines, (first, end), in `out`."""
    mark = "_found"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark = f"_{mark}"
    i, h, r = (f"{mark}_{c}" for c in "ihr")
    found = repeats(df, id, text, run, words).toDF(i, h, r)
    # always a merge: what is found outgrows a broadcast, and the plan of small tables would be another one
    joined = df.join(found.hint("merge"), df[id].eqNullSafe(F.col(i)) & (F.xxhash64(df[text]) == F.col(h)), "left")
    left = F.when(F.col(r).isNull(), F.col(text)).otherwise(F.array_join(kept_lines(F.split(F.col(text), "\n", -1), F.col(r)), "\n"))
    runs = F.coalesce(r, F.array().cast("array<struct<first:int,end:int>>"))
    columns = [left.alias(c) if c == text else F.col(f"`{c}`") for c in df.columns if c != out]
    return joined.select(*columns, runs.alias(out))
