"""Projections, predicates, changes of rows and columns, list functions and small reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import shrink
from tidemark.operators import windows as W
from tidemark.plans.registry import query, r
from tidemark.sources import tables


@query("""
SELECT p_partkey, CASE WHEN p_size <= 5 THEN 5 WHEN p_size <= 10 THEN 10 WHEN p_size <= 20 THEN 20 WHEN p_size <= 30 THEN 30 WHEN p_size <= 40 THEN 40 ELSE 99 END AS level,
  CASE p_brand WHEN 'Brand#11' THEN 'first' WHEN 'Brand#12' THEN 'second' ELSE 'other' END AS kind FROM part
""")
def case_levels(t):
    level = F.when(F.col("p_size") <= 5, 5)
    for limit in (10, 20, 30, 40):
        level = level.when(F.col("p_size") <= limit, limit)
    kind = F.when(F.col("p_brand") == "Brand#11", "first").when(F.col("p_brand") == "Brand#12", "second").otherwise("other")
    return t("part").select("p_partkey", level.otherwise(99).alias("level"), kind.alias("kind"))


@query("""
WITH l AS (SELECT c_custkey, min(o_orderstatus) AS status FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1)
SELECT c_custkey, (status = 'F') IS TRUE AS is_f, (status = 'F') IS FALSE AS is_not_f, status IS NOT DISTINCT FROM NULL AS unknown, coalesce(nullif(status, 'O'), 'none') AS shown FROM l
""")
def null_safe_tests(t):
    big = t("orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderstatus").alias("status"))
    j = t("customer").select("c_custkey").join(big, "c_custkey", "left")
    f, s = F.col("status") == "F", F.col("status")
    return j.select("c_custkey", f.eqNullSafe(True).alias("is_f"), f.eqNullSafe(False).alias("is_not_f"), s.eqNullSafe(F.lit(None)).alias("unknown"), F.coalesce(F.nullif(s, F.lit("O")), F.lit("none")).alias("shown"))


@query("""
WITH v AS (SELECT event_id, value, CASE WHEN value > 10 THEN 'high' ELSE 'low' END AS band FROM events)
SELECT event_id, band, band = 'high' AND event_id % 2 = 0 AS chosen, TRY_CAST(CASE WHEN event_id % 2 = 0 THEN CAST(event_id AS VARCHAR) ELSE 'x' END AS BIGINT) AS even_id, value BETWEEN 10 AND 500 AS middling FROM v
""")
def chained_columns(t):
    """Columns that build on each other, and a range of a value as a flag."""
    e = t("events").withColumn("band", F.when(F.col("value") > 10, "high").otherwise("low"))
    text = F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).otherwise("x")
    e = e.withColumn("chosen", (F.col("band") == "high") & (F.col("event_id") % 2 == 0))
    return e.select("event_id", "band", "chosen", text.try_cast("bigint").alias("even_id"), F.col("value").between(10, 500).alias("middling"))


@query("""
SELECT s.s_suppkey, coalesce(x.total, 0.0) AS total, s.s_name AS supplier_name, FALSE AS flagged FROM supplier s
LEFT JOIN (SELECT l_suppkey, round(sum(l_quantity), 2) AS total FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) x ON x.l_suppkey = s.s_suppkey
""")
def update_from_join(t):
    """A column with a default that a join updates, and a renamed one."""
    base = t("supplier").select("s_suppkey", "s_name").withColumn("total", F.lit(0.0)).withColumn("flagged", F.lit(False)).withColumnRenamed("s_name", "supplier_name")
    new = t("lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(r(F.sum("l_quantity"), 2).alias("total"))
    return tables.updated(base, new, "s_suppkey", ["total"])


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def delete_not_in(t):
    """Rows whose key isn't in the sample are pruned."""
    sample = t("customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return tables.kept_in(t("orders").select("o_orderkey", "o_custkey"), sample, "o_custkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 250000 AND o_orderdate < TIMESTAMP '1997-01-01'")
def bound_parameters(t):
    """SQL with named parameters, also for a column's name."""
    df = t("orders")
    return df.sparkSession.sql("SELECT o_orderkey, IDENTIFIER(:column) AS o_totalprice FROM {orders} WHERE IDENTIFIER(:column) >= :least AND o_orderdate < CAST(:before AS timestamp_ntz)", args={"column": "o_totalprice", "least": 250000, "before": "1997-01-01"}, orders=df)


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderdate ORDER BY md5(CAST(o_orderkey AS VARCHAR))) AS place FROM orders")
def md5_tie_break(t):
    from pyspark.sql import Window

    w = Window.partitionBy("o_orderdate").orderBy(F.md5(F.col("o_orderkey").cast("string")))
    return t("orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


@query("SELECT o_orderpriority, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) AS pct FROM orders GROUP BY 1")
def window_over_aggregate(t):
    g = t("orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))  # a few rows, so the window has no key
    return g.select("o_orderpriority", "n", r(F.lit(100.0) * F.col("n") / F.sum("n").over(W.whole([])), 4).alias("pct"))


@query("SELECT CAST(year(o_orderdate) AS BIGINT) AS year, date_trunc('month', o_orderdate) AS month, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS positives FROM orders GROUP BY ALL")
def month_distribution(t):
    month = F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")
    return t("orders").groupBy(F.year("o_orderdate").cast("long").alias("year"), month).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("positives"))


@query("SELECT p_name, count(*) AS n, count(DISTINCT p_brand) AS brands FROM part GROUP BY 1 HAVING count(*) > 1 OR p_name LIKE '%1%'")
def homonyms(t):
    g = t("part").groupBy("p_name").agg(F.count("*").alias("n"), F.countDistinct("p_brand").alias("brands"))
    return g.where((F.col("n") > 1) | F.col("p_name").contains("1"))


@query("""
WITH a AS (SELECT l_orderkey, list_sort(list(l_linenumber * 10 + CASE l_returnflag WHEN 'A' THEN 1 ELSE 2 END)) AS x FROM lineitem GROUP BY 1)
SELECT l_orderkey, CAST(list_sum(x) AS BIGINT) AS total, list_max(x) AS most, CAST(len(x) AS INTEGER) AS n, CAST(len(list_distinct(x)) AS INTEGER) AS kinds, CAST(len(list_filter(x, lambda v: v % 10 = 1)) AS INTEGER) AS agree,
  CAST(coalesce(list_position(x, 21), 0) AS BIGINT) AS place_of_21, x[2] AS second, array_to_string(list_transform(x, lambda v: v + 1), ',') AS shifted FROM a
""")
def list_functions(t):
    x = F.col("x")
    value = F.col("l_linenumber") * 10 + F.when(F.col("l_returnflag") == "A", 1).otherwise(2)
    a = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(value)).alias("x"))
    return a.select(
        "l_orderkey", F.aggregate(x, F.lit(0).cast("long"), lambda s, v: s + v).alias("total"), F.array_max(x).alias("most"), F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("kinds"),
        F.size(F.filter(x, lambda v: v % 10 == 1)).alias("agree"), F.array_position(x, 21).alias("place_of_21"), F.get(x, F.lit(1)).alias("second"), F.array_join(F.transform(x, lambda v: (v + 1).cast("string")), ",").alias("shifted"),
    )


@query("""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, o_custkey, row_number() OVER (PARTITION BY o_custkey, l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey) AS a,
  row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_suppkey) AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT o_custkey, count(*) AS events, count(CASE WHEN a = 1 THEN 1 END) AS counterparts, count(CASE WHEN b = 1 THEN 1 END) AS taxa, round(CAST(count(CASE WHEN a = 1 THEN 1 END) AS DOUBLE) / count(*), 6) AS novelty FROM v GROUP BY 1
""")
def network_first_flags(t):
    """Distinct counterparts and parts from first-occurrence flags."""
    v = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    v = v.withColumns({"a": W.is_first(["o_custkey", "l_suppkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey"]), "b": W.is_first(["o_custkey", "l_partkey"], ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey"])})
    g = v.groupBy("o_custkey").agg(F.count("*").alias("events"), F.sum("a").alias("counterparts"), F.sum("b").alias("taxa"))
    return g.withColumn("novelty", r(shrink.ratio(F.col("counterparts"), F.col("events"))))


@query("""
WITH v AS (SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, lag(o_orderdate) OVER w AS last, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n,
  min(o_orderdate) OVER (PARTITION BY o_custkey) AS start FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_orderkey, CAST(date_part('day', o_orderdate - start) AS BIGINT) AS tenure_days, o_orderdate - start > INTERVAL 730 DAY AS veteran, n >= 20 AS reliable, CAST(date_part('day', o_orderdate - last) AS BIGINT) AS days_since_last FROM v
""")
def observer_tenure(t):
    o = t("orders").withColumns({
        "last": F.lag("o_orderdate").over(W.ordered(["o_custkey"], ["o_orderdate", "o_orderkey"])), "n": F.count(F.lit(1)).over(W.before(["o_custkey"], ["o_orderdate", "o_orderkey"])),
        "start": F.min("o_orderdate").over(W.whole(["o_custkey"])),
    })
    d, s = F.col("o_orderdate"), F.col("start")
    return o.select("o_orderkey", F.timestamp_diff("DAY", s, d).alias("tenure_days"), (d - s > F.expr("INTERVAL '730' DAY")).alias("veteran"), (F.col("n") >= 20).alias("reliable"), F.timestamp_diff("DAY", F.col("last"), d).alias("days_since_last"))
