"""Licence texts inside documents, with DataFrame expressions alone.

A text is cut into words and these into shingles of five. For each template, windows of the template's length and a
quarter more start at every quarter of it, so that some window holds any copy whole. MinHash bands of a window retrieve
the templates that share a band; then the share of the template's shingles that the window holds decides, exactly.

A band has one row: the shingle of the set with the least hash of that band. A window shares a band with a template only if it holds the
template's least shingle and none of its own has a smaller hash. So windows are built only around the least shingles of templates, of which each
has BANDS at most, and there the window's own least hash is compared.

A window that holds 0.8 of a template is retrieved with a probability over 0.9999: its Jaccard similarity with the template
is 0.8 / (1.25 + 0.2) at least, and (1 - 0.55) ** 16 < 3e-6.

The templates are one value of the plan, an array of structs over which the same expression goes, so the plan doesn't
grow with their number. They are a bounded parameter; TEMPLATES and the public texts in `license_texts` are the default.

Defined results: a null or short text has no match; copies get equal matches; several copies of a template in a text count once, with the
first place; extra columns are kept, those with the name of the output are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from importlib import resources

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = 5
BANDS = 16
CONTAINED = 0.8

#: Short public notices by which texts name their licence.
TEMPLATES = {
    "Apache-2.0-name": "Licensed under the Apache License, Version 2.0",
    "CC-BY-4.0-name": "Licensed under CC BY 4.0",
    "CC-BY-NC-4.0-name": "Licensed under CC BY-NC 4.0",
    "CC-BY-SA-4.0-name": "Licensed under CC BY-SA 4.0",
    "GPL-3.0-name": "This work is licensed under the GNU General Public License, version 3",
    "MIT-name": "Released under the MIT License",
}


def templates() -> dict[str, str]:
    """The short notices and the texts of the folder `license_texts` by name."""
    files = resources.files("tidemark.llm").joinpath("license_texts").iterdir()
    return TEMPLATES | {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(files, key=lambda f: f.name) if f.name.endswith(".txt")}


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once for all uses in lambdas."""
    return F.transform(F.array(value), use)[0]


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^a-z0-9\x{80}-\x{10ffff}]+"), "")


def shingles(words: Column) -> Column:
    """A hash of each five neighbouring words; none for fewer words."""
    hashed = F.transform(words, lambda w: F.xxhash64(w))
    five = lambda h: F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - (WORDS - 1), F.lit(0))), lambda x, k: F.xxhash64(x, *(h[k + n] for n in range(1, WORDS)))
    )
    return let(hashed, five)


_KNOWN = "array<struct<name:string,n:int,step:int,long:int,s:array<bigint>,bands:array<struct<no:int,shingle:bigint>>>>"


def table(spark: SparkSession, texts: dict[str, str]) -> list[dict]:
    """Each template with its shingles, the sizes of its windows and the least shingle of each band."""
    rows = spark.createDataFrame(sorted(texts.items()), "name string, text string").select("name", F.array_distinct(shingles(words_of(F.col("text")))).alias("s"))
    least = lambda s: F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.array_min(F.transform(s, lambda x: F.struct(F.xxhash64(x, b).alias("h"), x.alias("x"), b.alias("b")))))
    got = rows.select("name", "s", F.transform(least(F.col("s")), lambda m: m["x"]).alias("m")).collect()  # as many as there are templates
    if short := [r.name for r in got if not r.s]:
        raise ValueError(f"templates of fewer than {WORDS} words: {short}")
    steps = {r.name: max(1, len(r.s) // 4) for r in got}
    return [
        {"name": r.name, "n": len(r.s), "step": steps[r.name], "long": len(r.s) + steps[r.name], "s": r.s, "bands": [{"no": k + 1, "shingle": x} for k, x in enumerate(r.m)]} for r in got
    ]


def _match(have: Column, hits: Column, t: Column, contained: float) -> Column:
    """The first window that holds template t, as (license, word, share), or null; hits: places of least shingles."""
    step, long = t["step"], t["long"]
    own = F.filter(hits, lambda k: F.exists(t["bands"], lambda b: b["shingle"] == F.get(have, k)))
    around = lambda k: F.transform(F.sequence(F.lit(0), F.floor(long / step).cast("int")), lambda b: F.greatest((F.floor(k / step).cast("int") - b) * step, F.lit(0)))
    begins = F.array_sort(F.array_distinct(F.flatten(F.transform(own, around))))
    shared = lambda w: F.exists(
        t["bands"], lambda b: F.array_contains(w, b["shingle"]) & (F.array_min(F.transform(w, lambda x: F.xxhash64(x, b["no"]))) == F.xxhash64(b["shingle"], b["no"]))
    )
    found = lambda w, k: F.when(shared(w), F.struct(t["name"].alias("license"), k.alias("word"), (F.size(F.array_intersect(w, t["s"])) / t["n"]).alias("share")))
    scored = F.transform(begins, lambda k: let(F.slice(have, k + 1, long), lambda w: found(w, k)))
    return F.get(F.filter(scored, lambda m: m["share"] >= contained), F.lit(0))


def scan(df: DataFrame, texts: dict[str, str] | None = None, text: str = "text", out: str = "licenses", contained: float = CONTAINED) -> DataFrame:
    """df with an array of (license, word, share): each template of which a window holds that share of shingles or more.

    texts: templates by name, of five words at least; those of templates() if none are given.
    """
    known = table(df.sparkSession, templates() if texts is None else texts)
    array = F.from_json(F.lit(json.dumps(known)), _KNOWN)  # folded to one value
    least = sorted({b["shingle"] for t in known for b in t["bands"]})
    hits = lambda have: F.filter(F.transform(have, lambda x, k: F.when(x.isin(least), k)), lambda k: k.isNotNull())
    matches = lambda have, h: F.filter(F.transform(array, lambda t: _match(have, h, t, contained)), lambda m: m.isNotNull())
    none = F.array().cast("array<struct<license:string,word:int,share:double>>")
    found = lambda have: let(hits(have), lambda h: F.when(F.size(h) > 0, matches(have, h)).otherwise(none))
    return df.withColumn(out, F.coalesce(let(shingles(words_of(F.coalesce(F.col(text), F.lit("")))), found), none))
