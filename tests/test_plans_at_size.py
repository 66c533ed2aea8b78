"""Queries of tidemark/plans on inputs that small tables lack, compared with their SQL."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry


def plain(v):
    return ("nan" if math.isnan(v) else f"{v + 0.0:.9g}") if isinstance(v, float) else str(v)


@pytest.fixture
def same(spark, sf, tmp_path):
    """Compares a query with its SQL, some tables being replaced."""

    def run(name, **tables):
        con = duckdb.connect()
        for t in ("customer", "supplier", "part", "orders", "lineitem", "events"):
            (tables[t] if t in tables else spark.read.parquet(f"{sf}/{t}.parquet")).write.mode("overwrite").parquet(f"{tmp_path}/{t}.parquet")
            con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df = entry.queries()[name](spark, str(tmp_path))
        want = con.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        want = sorted([plain(v) for v in row] for row in want.fetchall())
        got = sorted([plain(v) for v in row] for row in df.select(*columns).collect())
        assert got == want and got
        return df

    return run


def exchanges(df):
    """Shuffles that the plan asks for."""
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


@pytest.mark.parametrize("name, most", [("consensus_windowed", 4), ("settlement_curve", 6), ("role_features", 6)])
def test_rows_are_dealt_out_few_times(spark, sf, name, most):
    assert exchanges(entry.queries()[name](spark, sf)) <= most


def test_votes_of_one_time_and_nodes_count_together(spark, sf, same):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    few = lines.withColumns({"l_orderkey": F.col("l_orderkey") % 40, "l_partkey": F.col("l_partkey") % 3, "l_shipdate": F.date_trunc("year", "l_shipdate").cast("timestamp_ntz")})
    for name in ("consensus_windowed", "settlement_curve", "label_windowed"):
        same(name, lineitem=few)


def test_roles_of_one_user_on_one_day(spark, sf, same):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    hours = F.make_dt_interval(F.lit(0), F.col("l_linenumber") * 3)
    flagged = F.when(F.col("l_partkey") % 7 != 0, F.col("l_returnflag"))
    lines = lines.withColumns({"l_suppkey": F.col("l_suppkey") % 3, "l_shipdate": F.when(F.col("l_orderkey") % 9 != 0, F.col("l_shipdate") + hours), "l_returnflag": flagged})
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumns({"o_custkey": F.col("o_custkey") % 5, "o_orderdate": F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate") + F.make_dt_interval(F.lit(0), F.lit(5)))})
    same("role_features", lineitem=lines, orders=orders)


def test_passes_of_a_fit_read_the_matrix_once_written(spark, sf):
    from tidemark.plans import training

    m, _, _ = training.fitted(lambda name: spark.read.parquet(f"{sf}/{name}.parquet"))
    assert m.inputFiles() and all("/matrix-" in f for f in m.inputFiles())


def test_half_seconds_go_to_the_even_one(spark, same):
    rows = [(k, 1, k // 2, float(k)) for k in range(20)]  # half seconds apart, then one, then two and a half
    rows += [(20 + k, 2, 0, 2.5 * k) for k in range(9)] + [(40 + k, 3, 0, 1.5 * k) for k in range(9)] + [(60 + k, 4, 0, 0.5 * k) for k in range(9)]
    e = spark.createDataFrame(rows, "event_id long, user_id long, kind int, s double")
    e = e.select("event_id", F.timestamp_micros((F.col("s") * 1_000_000).cast("long") + 1_000_000_000_000_000).cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    same("lag_interarrival", events=e)


def test_graph_of_parts_that_are_not_there(spark, sf, same):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey < 400")
    lines = lines.withColumn("l_orderkey", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_orderkey"))).withColumn("l_partkey", F.col("l_partkey") % 150)
    part = spark.read.parquet(f"{sf}/part.parquet").where("p_partkey % 4 != 0").withColumn("p_type", F.when(F.col("p_partkey") % 5 != 0, F.col("p_type")))
    for name in ("one_hop", "two_hop_stats", "clustering_coefficient", "topology_aggregates", "neighbourhood_rates", "neighbourhood_pool_rank", "pool_shrunk_rates", "degree_asymmetry", "rank_distance"):
        same(name, lineitem=lines, part=part)


@pytest.mark.parametrize("name, most", [("topology_aggregates", 6), ("degree_asymmetry", 4), ("rank_distance", 5), ("bipartite_edges", 5), ("union_all_roles", 4)])
def test_pairs_are_dealt_out_few_times(spark, sf, name, most):
    assert exchanges(entry.queries()[name](spark, sf)) <= most


def test_matrix_reads_lines_once_for_votes_and_once_for_roles(spark, sf):
    """Each of them shuffles the lines once, however many sums are taken of them, and roles as of an order go by user only as sums of years."""
    df = entry.queries()["training_matrix"](spark, sf)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and sum("Relation" in x and "l_orderkey#" in x for x in plan.split("\n")) == 2
    assert exchanges(entry.queries()["role_features"](spark, sf)) <= 4 and exchanges(entry.queries()["consensus_windowed"](spark, sf)) <= 2


def test_votes_that_rise_and_fall(spark):
    """What is agreed on is the same, told only at times that vote for a candidate or at all times."""
    import random

    from tidemark.operators import consensus

    rng = random.Random(8)
    node = lambda n, level: {"node": n, "level": level}
    rows = []
    for k in range(900):
        leaf, kind = rng.choice("abc"), rng.choice("xy")
        path = [] if k % 11 == 0 else [node(leaf, 10), node(kind, 20)][k % 2 :]
        rows.append((k % 60, rng.randrange(40), path, k, k % 5))
    v = spark.createDataFrame(rows, "item int, day int, path array<struct<node string, level int>>, vote int, user int")
    v = v.select("item", F.timestamp_seconds(F.lit(0)).alias("created"), F.timestamp_seconds(F.col("day") * 86400).alias("time"), "path", "vote", "user")
    for days in (None, 3, 12, 30):
        a, b = (sorted(map(str, consensus.at(steps, days).collect())) for steps in (consensus.timeline(v, least=2), consensus.decisive(v, least=2)))
        assert a == b and a
