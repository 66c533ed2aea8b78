"""Queries that see every row of their input."""

import __spark_entry__ as entry


def test_degrees_count_every_edge(spark, sf):
    got = {r.node: r.out_degree for r in entry.queries()["degree_asymmetry"](spark, sf).collect()}
    bought = {}
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_partkey").collect():
        bought.setdefault(r.l_orderkey, set()).add(r.l_partkey)
    near = {}
    for parts in bought.values():
        for a in parts:
            near.setdefault(a, set()).update(parts - {a})
    assert got == {a: len(x) for a, x in near.items() if x} and max(got.values()) > 10


def test_every_event_is_there(spark, sf):
    assert entry.queries()["chained_columns"](spark, sf).count() == spark.read.parquet(f"{sf}/events.parquet").count()


def test_no_query_is_there_twice():
    assert not [name for name in entry.queries() if name.endswith("_all")]
