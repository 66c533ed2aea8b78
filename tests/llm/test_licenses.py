import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import licenses as L
from tidemark.llm import queries


def words(t):
    return [w for w in re.split(r"[^a-z0-9\x80-\U0010ffff]+", (t or "").lower()) if w]


def five(w):
    return [tuple(w[k : k + 5]) for k in range(len(w) - 4)]


ALL = {n: set(five(words(t))) for n, t in L.templates().items()}


def brute(text):
    have, out = five(words(text)), set()
    for name, want in ALL.items():
        if len(want & set(have)) < 0.8 * len(want):
            continue
        step = max(1, len(want) // 4)
        long = len(want) + step
        if any(len(want & set(have[k : k + long])) >= 0.8 * len(want) for k in range(0, max(1, len(have)), step)):
            out.add(name)
    return out


TEXT = L.templates()
LONG = "Permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"
TEXTS = [
    None, "", "one two", "x " * 7 + "Released under the MIT License. y", "Licensed under the Apache\nLicense, version 2.0!", "licensed under cc by-nc 4.0 licensed under cc by-nc 4.0",
    "pad " * 301 + LONG + " more" * 50, "a b c " + LONG.replace("charge", "CHARGE,") + " d", LONG.replace("obtaining", "getting"), "the mit license released under", "w " * 50000 + "released under the mit license",
    "pad " * 3 + " ".join(LONG.split()[2:]) + " z" * 9, "pad " * 77 + TEXT["MIT"] + " pad" * 33, TEXT["GPL-3.0"], "a b " * 9 + TEXT["Apache-2.0"].replace("License", "Licence", 9) + TEXT["ISC"],
    " ".join(TEXT["MPL-2.0"].split()[200:2600]), " ".join(TEXT["GPL-2.0-notice"].split()[:-6]), " ".join(TEXT["BSD-3-Clause"].split()[:90]), TEXT["Zlib"] + TEXT["Zlib"],
]


def test_matches_equal_brute_force(spark):
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, licenses int")
    got = {r.doc_id: {m.license for m in r.licenses} for r in L.scan(df).collect()}
    for k, t in enumerate(TEXTS):
        assert got[k] == brute(t), (k, t and t[:60])
    assert got[3] == {"MIT-name"} and got[12] == {"MIT"} and {"GPL-3.0", "GPL-3.0-notice"} <= got[13] and "ISC" in got[14] and "MPL-2.0" in got[15]
    assert L.scan(df.limit(0)).count() == 0


def test_bands_retrieve(spark):
    """A window without any least shingle isn't compared, however many other shingles of the template it has."""
    words = [f"w{k}" for k in range(60)]
    (known,) = L.table(spark, {"t": " ".join(words)})
    least = {b["shingle"] for b in known["bands"]}
    place = {x: k for k, x in enumerate(known["s"])}
    p = sorted(place[x] for x in least)
    free = max(b - a for a, b in zip([-1, *p], [*p, 56], strict=True))
    assert 1 < len(least) <= L.BANDS and free > 1
    gap = next(a for a, b in zip([-1, *p], [*p, 56], strict=True) if b - a == free)
    df = spark.createDataFrame([(" ".join(words[gap + 1 : gap + free + 4]),), (" ".join(words[: p[0] + 5]),)], "text string")
    some, other = (len(r.licenses) for r in L.scan(df, {"t": " ".join(words)}, contained=1 / 56).collect())
    assert (some, other) == (0, 1)


def test_short_templates_are_refused(spark):
    with pytest.raises(ValueError):
        L.scan(spark.range(1).select(F.lit("a").alias("text")), {"x": "too short"})


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    rows = queries.op6_license_scan(spark, sf).collect()
    got = {r.doc_id: r.licenses for r in rows}
    want = {d.doc_id: ",".join(sorted(brute(d.text))) for d in docs}
    assert got == want and sum(map(bool, want.values())) > 10
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(con.execute(queries.ORACLES["op6_license_scan"]).fetchall()) == sorted(map(tuple, rows))
