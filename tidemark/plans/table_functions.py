"""Parametrised table functions that SQL calls by name, as macros: SELECT * FROM consensus_within(400)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import labels
from tidemark.plans.registry import query, r

#: What the functions read, as temporary views: votes (item, created, time, path) with path an array of (node, level), and days (key, ordered, shipped).
VOTES, DAYS = "tidemark_votes", "tidemark_days"

CONSENSUS = f"""
CREATE OR REPLACE TEMPORARY FUNCTION consensus_within(days INT COMMENT 'votes count up to so many days after the item was made')
RETURNS TABLE (item BIGINT, node STRING, level INT, decided TIMESTAMP_NTZ, supporters BIGINT, total BIGINT)
RETURN
WITH v AS (SELECT * FROM {VOTES} WHERE time <= created + make_dt_interval(consensus_within.days)),
each AS (SELECT item, time, p.node, p.level, count(place) AS for_it, count_if(coalesce(place, 0) = 0) AS votes FROM v LATERAL VIEW OUTER posexplode(path) AS place, p GROUP BY ALL),
by_time AS (SELECT item, time, sum(votes) AS n, collect_list(CASE WHEN for_it > 0 THEN struct(node, level, for_it) END) AS held FROM each GROUP BY item, time),
at AS (SELECT item, time, held, sum(n) OVER (PARTITION BY item ORDER BY time) AS total FROM by_time),
candidate AS (SELECT item, node, level FROM each WHERE for_it > 0 GROUP BY item, node, level HAVING sum(for_it) >= 2),
step AS (SELECT c.item, c.node, c.level, at.time, at.total,
  sum(aggregate(filter(at.held, x -> x.node = c.node AND x.level = c.level), 0L, (n, x) -> n + x.for_it)) OVER (PARTITION BY c.item, c.node, c.level ORDER BY at.time) AS supporters
  FROM candidate c JOIN at ON at.item = c.item),
first AS (SELECT item, min_by(struct(*), struct(level, time, node)) AS x FROM step WHERE 3 * supporters >= 2 * total AND supporters >= 2 GROUP BY item)
SELECT item, x.node, x.level, x.time, x.supporters, x.total FROM first
"""

HISTOGRAM = f"""
CREATE OR REPLACE TEMPORARY FUNCTION histogram_by_week(day STRING COMMENT 'ordered or shipped')
RETURNS TABLE (key INT, counts ARRAY<BIGINT>, total BIGINT)
RETURN
WITH w AS (SELECT key, weekofyear(CASE histogram_by_week.day WHEN 'ordered' THEN ordered WHEN 'shipped' THEN shipped END) AS week, count(*) AS n FROM {DAYS} GROUP BY ALL),
k AS (SELECT key, map_from_entries(collect_list(struct(week, n)) FILTER (WHERE week IS NOT NULL)) AS m, coalesce(sum(n) FILTER (WHERE week IS NOT NULL), 0) AS total FROM w GROUP BY key)
SELECT key, transform(sequence(1, 53), week -> coalesce(m[week], 0L)), total FROM k
"""


def register(spark: SparkSession, votes: DataFrame, days: DataFrame) -> None:
    """Makes consensus_within and histogram_by_week callable in the session's SQL, over these tables."""
    votes.createOrReplaceTempView(VOTES)
    days.createOrReplaceTempView(DAYS)
    spark.sql(CONSENSUS)
    spark.sql(HISTOGRAM)


def registered(t) -> SparkSession:
    lines = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    days = lines.select(F.col("c_nationkey").alias("key"), F.col("o_orderdate").alias("ordered"), F.col("l_shipdate").alias("shipped"))
    spark = days.sparkSession
    register(spark, labels.votes(t), days)
    return spark


@query(f"WITH {labels.VOTES}, {labels.agreed_sql(90, 'a')}, {labels.agreed_sql(730, 'b')} SELECT item, a.node AS early, b.node AS late, b.level, b.supporters, b.total, a.node IS NOT DISTINCT FROM b.node AS stays FROM b LEFT JOIN a USING (item)")
def consensus_function(t):
    """What is agreed on after 90 days and after two years, by one table function called twice from SQL."""
    return registered(t).sql("""
    SELECT item, a.node AS early, b.node AS late, b.level, b.supporters, b.total, a.node <=> b.node AS stays FROM consensus_within(730) AS b LEFT JOIN consensus_within(90) AS a USING (item)
    """)


@query("""
WITH d AS (SELECT c_nationkey AS key, l_shipdate AS day FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey),
w AS (SELECT key, week(day) AS week, count(*) AS n FROM d GROUP BY 1, 2),
f AS (SELECT k.key, s.week, coalesce(w.n, 0) AS n FROM (SELECT DISTINCT key FROM w) k CROSS JOIN (SELECT unnest(range(1, 54)) AS week) s LEFT JOIN w ON w.key = k.key AND w.week = s.week)
SELECT key AS nation, string_agg(CAST(n AS VARCHAR), ',' ORDER BY week) AS counts, CAST(sum(n) AS BIGINT) AS total, round(CAST(max(n) AS DOUBLE) / sum(n), 6) AS peak_share FROM f GROUP BY 1
""")
def histogram_function(t):
    """Weeks in which each nation's orders were shipped, by a table function called from SQL."""
    h = registered(t).sql("SELECT key AS nation, array_join(transform(counts, n -> string(n)), ',') AS counts, total, array_max(counts) AS peak FROM histogram_by_week('shipped')")
    return h.select("nation", "counts", "total", r(F.col("peak") / F.col("total").cast("double")).alias("peak_share"))
