"""I-Match fingerprints of documents by DataFrame functions alone.

The terms of a text are its lower-case runs of letters and digits. A corpus lexicon keeps the terms whose inverse
document frequency ln(N / df) lies within a band; a text is told by the sorted distinct terms that it has of the lexicon.
One hash of all of them is the classic fingerprint. Besides, FAMILIES x LEVELS randomised subsets of the lexicon are hashed:
at level j of a family a term is in the subset if the first j bits of its hash in that family are zero, so levels
halve the lexicon again and again and a text of any length has levels at which its subsets hold about one term.

The lexicon is small by its band: a term of it is in at least N / e^most documents, so it has at most (mean number of
distinct terms of a document) * e^most entries, whatever N is. It is counted before it is broadcast; beyond BROADCAST
entries it is joined by a shuffle.

Defined results: a null text counts as empty. A text without a term of the lexicon is told by a hash of itself. Equal
texts have equal fingerprints, repeated rows each have their own, null ids stay. Extra columns are kept by `fingerprint`, but those with the names
of its output columns are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import ranges, saved

#: Terms stay from half of all documents (0.69) down to one in a thousand (6.9), but never those of one document only.
BAND = (math.log(2), math.log(1000))
#: Independent families of subsets, levels of each, and the levels that are compared at a time.
FAMILIES, LEVELS, NEAR = 8, 12, 3
#: Entries of a lexicon that are broadcast at most (8 bytes each).
BROADCAST = 2_000_000
#: Hexadecimal digits of the hash of all terms, and of a subset's.
WHOLE, CELL = 16, 4
#: Bytes of text that neighbouring documents share a task for, on average.
BUCKET = 4 << 20


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once for all uses in lambdas."""
    return F.transform(F.array(value), use)[0]


def terms(text: Column | str) -> Column:
    """Hashes of the distinct lower-case runs of letters and digits."""
    words = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """(term): the hashes of terms whose inverse document frequency lies within the band, over all documents."""
    n = docs.count()
    least, most = max(2, math.ceil(n / math.exp(band[1]) - 1e-9)), math.floor(n / math.exp(band[0]) + 1e-9)
    counted = docs.select(F.explode(terms(text)).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return counted.where(F.col("df").between(least, max(most, least))).select("term")


def written(kept: Column, own: Column) -> Column:
    """The fingerprint of a text with the terms `kept`, sorted, of the lexicon; own: a hash of the text, for texts without such terms."""
    cell = lambda s: F.when(F.size(s) == 0, 0).otherwise(F.pmod(F.xxhash64(s), F.lit(65535)) + 1).cast("long")
    halve = lambda f: lambda acc, j: let(
        F.filter(acc["left"], lambda t: F.call_function("shiftrightunsigned", F.xxhash64(t, f), 64 - j) == 0),
        lambda left: F.struct(left.alias("left"), F.concat(acc["cells"], F.array(cell(left))).alias("cells")),
    )
    none = F.lit([]).cast("array<bigint>")
    levels = lambda f: F.aggregate(F.sequence(F.lit(1), F.lit(LEVELS)), F.struct(kept.alias("left"), none.alias("cells")), halve(f), lambda acc: acc["cells"])
    cells = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(FAMILIES)), levels))
    digits = F.array_join(F.transform(cells, lambda c: F.lpad(F.lower(F.hex(c)), CELL, "0")), "")
    whole = lambda x: F.lpad(F.lower(F.hex(x)), WHOLE, "0")
    return F.when(F.size(kept) == 0, F.concat(F.lit("-"), whole(own))).otherwise(F.concat(whole(F.xxhash64(kept)), digits))


def likeness(a: Column, b: Column) -> Column:
    """How alike two fingerprints are, from 0 to 1: 1 for equal ones; else the share of equal subsets among those that either text has terms in.

    NEAR levels are compared at a time, from the full to the sparse ones; of those in which half of the subsets or more
    are occupied, the highest share counts. Sparse levels estimate the Jaccard similarity of the texts' terms.
    """
    cell = lambda x, f, j: F.substring(x, WHOLE + 1 + (f * LEVELS + j) * CELL, F.lit(CELL))
    empty, full = F.lit("0" * CELL), FAMILIES * NEAR / 2

    def level(j: Column) -> Column:
        pairs = F.transform(F.sequence(F.lit(0), F.lit(FAMILIES - 1)), lambda f: F.struct(cell(a, f, j).alias("a"), cell(b, f, j).alias("b")))
        used = F.filter(pairs, lambda p: (p["a"] != empty) | (p["b"] != empty))
        return let(used, lambda u: F.struct(F.size(u).alias("used"), F.size(F.filter(u, lambda p: p["a"] == p["b"])).alias("same")))

    levels = F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), level)
    total = lambda x, k, of: F.aggregate(F.slice(x, k + 1, NEAR), F.lit(0), lambda s, v: s + v[of])
    share = lambda x, k: let(total(x, k, "used"), lambda used: F.when((used >= full) | (k == 0), total(x, k, "same") / F.greatest(used, F.lit(1))))
    best = let(levels, lambda x: F.array_max(F.transform(F.sequence(F.lit(0), F.lit(LEVELS - NEAR)), lambda k: share(x, k))))
    return F.when(a == b, 1.0).when(a.startswith("-") | b.startswith("-"), 0.0).otherwise(best)


def _kept(rows: DataFrame, keys: list[str], texts: dict[str, Column], held: Column, found: DataFrame) -> DataFrame:
    """(keys, held, a column for each of `texts` with its sorted terms of the lexicon `found`), one row for each row.

    Where rows are dealt out by some of the keys, nothing is shuffled: terms meet again in the task that they came from.
    `held` goes along once for each row, not with each term.
    """
    n = found.count()
    known = found.withColumn("known", F.col("term"))
    none = F.lit(None).cast("array<bigint>")
    each = [F.struct(F.lit(-1).alias("k"), none.alias("t"), held.alias("held")), *(F.struct(F.lit(k).alias("k"), terms(t).alias("t"), F.when(F.lit(False), held).alias("held")) for k, t in enumerate(texts.values()))]
    flat = rows.select(*keys, F.explode(F.array(*each)).alias("x")).select(*keys, "x.k", "x.held", F.explode_outer("x.t").alias("term"))
    told = flat.join(F.broadcast(known) if n <= BROADCAST else known, "term", "left")
    lists = [F.array_sort(F.collect_list(F.when(F.col("k") == k, F.col("known")))).alias(name) for k, name in enumerate(texts)]
    return told.groupBy(*keys).agg(F.first("held", ignorenulls=True).alias("held"), *lists)


def fingerprint(docs: DataFrame, text: str = "text", out: str = "fingerprint", band: tuple[float, float] = BAND, terms_of: DataFrame | None = None) -> DataFrame:
    """docs with their fingerprints by the lexicon `terms_of` (term), or that of docs themselves."""
    found = saved(terms_of if terms_of is not None else lexicon(docs, text, band), "lexicon")
    t = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(*(F.col(c) for c in docs.columns if c != out)).withColumns({"_a": F.xxhash64(t), "_b": F.xxhash64(F.reverse(t))})
    one = keyed.select("_a", "_b", t.alias("_text")).dropDuplicates(["_a", "_b"])  # equal texts have equal fingerprints
    told = _kept(one, ["_a", "_b"], {"_kept": F.col("_text")}, F.xxhash64("_text"), found)
    return keyed.join(told.select("_a", "_b", written(F.col("_kept"), F.col("held")).alias(out)), ["_a", "_b"]).drop("_a", "_b")


def with_next(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(bucket, place, guest, id, text, next_text): each document with the text of the next one by descending id; the first one follows the last.

    Documents are dealt out to buckets of neighbouring ids by bounds from a sample; rows of one id are told apart by a hash of
    their texts. Each bucket also gets the row that follows its last one as a guest, whose own next_text means nothing.
    """
    keyed = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"))
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    bucketed = keyed.withColumn("bucket", ranges(keyed, ["id", "h"], -(-size // BUCKET)))
    last = saved(bucketed.groupBy("bucket").agg(F.max(F.struct("id", "h")).alias("m")), "last")  # one row for each bucket
    after = F.coalesce(F.lead("bucket").over(Window.orderBy("bucket")), F.first("bucket").over(Window.orderBy("bucket")))
    guests = F.broadcast(last.select(F.col("m.id").alias("gid"), F.col("m.h").alias("gh"), after.alias("guest_in")))
    both = bucketed.join(guests, F.col("id").eqNullSafe(F.col("gid")) & (F.col("h") == F.col("gh")), "left").drop("gid", "gh")
    stay = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("guest"))
    placed = both.withColumn("x", F.explode(F.when(F.col("guest_in").isNull(), F.array(stay)).otherwise(F.array(stay, F.struct(F.col("guest_in").alias("b"), F.lit(1).alias("guest"))))))
    # ascending, so that the next document is the row before; the guest comes first
    order = Window.partitionBy("bucket").orderBy(F.desc("guest"), F.asc_nulls_first("id"), "h")
    found = placed.select(F.col("x.b").alias("bucket"), F.col("x.guest").alias("guest"), "id", "h", "text").repartition("bucket")
    return found.withColumns({"place": F.row_number().over(order), "next_text": F.lag("text").over(order)}).drop("h")


def compare_edited(docs: DataFrame, id: str = "doc_id", text: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """How a fingerprint stands up to editing: of each document, of its edited text and of the next document.

    The edited text has, in place of the last half of its code points, as many of the beginning of the next document. Returns
    id, n_chars, edited_sha256, both fingerprints, and how alike the document's is to the edited text's and to the next document's.
    """
    found = saved(lexicon(docs, text, band), "lexicon")
    t, following = F.coalesce("text", F.lit("")), F.coalesce("next_text", F.lit(""))
    n = F.length(t)
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(t, F.lit(1), n - half), F.substring(following, F.lit(1), half))
    rows = with_next(docs, id, text).select("bucket", "place", "guest", "id", t.alias("text"), n.cast("long").alias("n_chars"), edited.alias("edited"))
    held = F.struct("guest", "id", "n_chars", F.sha2("edited", 256).alias("sha"), F.xxhash64("text").alias("own"), F.xxhash64("edited").alias("other"))
    told = _kept(rows, ["bucket", "place"], {"a": F.col("text"), "b": F.col("edited")}, held, found)
    told = told.select("bucket", "place", "held.*", written(F.col("a"), F.col("own")).alias("fingerprint"), written(F.col("b"), F.col("other")).alias("edited_fingerprint"))
    beside = told.withColumn("following", F.lag("fingerprint").over(Window.partitionBy("bucket").orderBy("place"))).where("guest = 0")
    mine = F.col("fingerprint")
    return beside.select(F.col("id").alias(id), "n_chars", F.col("sha").alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness(mine, F.col("edited_fingerprint")).alias("near_edited"), likeness(mine, F.col("following")).alias("near_next"))
