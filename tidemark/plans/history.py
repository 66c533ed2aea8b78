"""Histories: running statistics of each entity without the current row, trailing windows, ranks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import shrink
from tidemark.operators import windows as W
from tidemark.plans.registry import query, r



def positive():
    return (F.col("o_orderstatus") == "F").cast("int")


BY_CUSTOMER = (["o_custkey"], ["o_orderdate", "o_orderkey"])
SQL_BEFORE = "ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def with_history(t):
    """Orders with y, the customer's orders and positives so far and p, the rate so far of their nation.

    Nations are few and hold many orders each, so theirs are sums by day; a customer's are a window.
    """
    o = t("orders").join(t("customer").select("c_custkey", "c_nationkey"), F.col("c_custkey") == F.col("o_custkey")).withColumn("y", positive())
    o = W.running_totals(o, ["c_nationkey"], BY_CUSTOMER[1], {"nation_n": F.lit(1), "nation_k": F.col("y")}, F.to_date("o_orderdate"))
    mine = W.before(*BY_CUSTOMER)
    p = F.coalesce(shrink.ratio(F.col("nation_k"), F.col("nation_n")), F.lit(0.5))
    return o.withColumns({"n_before": F.count(F.lit(1)).over(mine), "positives_before": F.coalesce(F.sum("y").over(mine), F.lit(0)), "p": p})


@query(f"""
WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate, c_nationkey, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y
  FROM orders JOIN customer ON c_custkey = o_custkey),
h AS (SELECT o_orderkey, o_custkey,
  count(*) OVER (PARTITION BY o_custkey {SQL_BEFORE}) AS n, coalesce(sum(y) OVER (PARTITION BY o_custkey {SQL_BEFORE}), 0) AS k,
  coalesce(avg(y) OVER (PARTITION BY c_nationkey {SQL_BEFORE}), 0.5) AS p FROM o)
SELECT o_orderkey, o_custkey, n AS n_before, CAST(k AS BIGINT) AS positives_before, round(p, 6) AS prior, round((10.0 * p + k) / (10.0 + n), 6) AS rate_shrunk FROM h
""")
def observer_history_shrunk(t):
    """Each customer's positive rate so far, drawn towards the rate so far of their nation."""
    o = with_history(t)
    return o.select("o_orderkey", "o_custkey", "n_before", "positives_before", r("p").alias("prior"), r(shrink.shrunk(F.col("positives_before"), F.col("n_before"), F.col("p"), 10)).alias("rate_shrunk"))


@query("""
SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1
""")
def first_event_per_key(t):
    return t("events").withColumn("k", W.is_first(["user_id"], ["ts", "event_id"])).where("k = 1").select("user_id", "event_id", "event_type")


@query(f"""
SELECT o_orderkey, count(*) OVER w AS n, round(sum(o_totalprice) OVER w, 2) AS total, round(avg(o_totalprice) OVER w, 4) AS mean, max(o_totalprice) OVER w AS highest
FROM orders WINDOW w AS (PARTITION BY o_custkey {SQL_BEFORE})
""")
def running_stats_excl_current(t):
    w, p = W.before(*BY_CUSTOMER), "o_totalprice"
    return t("orders").select("o_orderkey", F.count(F.lit(1)).over(w).alias("n"), r(F.sum(p).over(w), 2).alias("total"), r(F.avg(p).over(w), 4).alias("mean"), F.max(p).over(w).alias("highest"))


@query(f"""
SELECT o_orderkey, round(stddev_samp(CAST(day(o_orderdate) AS DOUBLE)) OVER (PARTITION BY o_custkey {SQL_BEFORE}), 4) AS spread FROM orders
""")
def running_stddev(t):
    return t("orders").select("o_orderkey", r(F.stddev_samp(F.dayofmonth("o_orderdate").cast("double")).over(W.before(*BY_CUSTOMER)), 4).alias("spread"))


@query(f"""
SELECT o_orderkey, CAST(quantile_cont(CAST(day(o_orderdate) AS DOUBLE), 0.5) OVER (PARTITION BY o_custkey {SQL_BEFORE}) AS DOUBLE) AS middle FROM orders
""")
def running_median(t):
    """Of days, which have few values: a running percentile costs more with each distinct one."""
    return t("orders").select("o_orderkey", F.percentile(F.dayofmonth("o_orderdate").cast("double"), F.lit(0.5)).over(W.before(*BY_CUSTOMER)).alias("middle"))


@query(f"""
SELECT o_orderkey, round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) OVER w, 0), 2) AS positive_total,
  count(CASE WHEN o_orderstatus = 'F' THEN 1 END) OVER w AS positives, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) OVER w, 4) AS positive_mean
FROM orders WINDOW w AS (PARTITION BY o_custkey {SQL_BEFORE})
""")
def running_filtered_sum(t):
    w, some = W.before(*BY_CUSTOMER), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    return t("orders").select("o_orderkey", r(F.coalesce(F.sum(some).over(w), F.lit(0.0)), 2).alias("positive_total"), F.count(some).over(w).alias("positives"), r(F.avg(some).over(w), 4).alias("positive_mean"))


@query("""
SELECT e.event_id, (SELECT count(DISTINCT p.event_type) FROM events p WHERE p.user_id = e.user_id AND (p.ts < e.ts OR (p.ts = e.ts AND p.event_id < e.event_id))) AS kinds FROM events e
""")
def running_distinct(t):
    return W.running_distinct(t("events"), ["user_id"], "event_type", ["ts", "event_id"], "kinds").select("event_id", "kinds")


@query("""
SELECT o_orderkey, round(percent_rank() OVER (PARTITION BY date_trunc('month', o_orderdate) ORDER BY o_totalprice NULLS LAST), 6) AS place FROM orders
""")
def percent_rank_month(t):
    """Months are few and hold many orders, so prices are ranked in steps of a thousand."""
    o = t("orders").withColumn("month", F.date_trunc("month", "o_orderdate"))
    return W.percent_rank(o, ["month"], "o_totalprice", F.floor(F.col("o_totalprice") / 1000), "place").select("o_orderkey", r("place").alias("place"))


@query("""
SELECT event_id, CAST(epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS BIGINT) AS seconds_since_last FROM events
""")
def lag_interarrival(t):
    """Whole seconds since the user's last event; halves go to the even second, as SQL's cast has it."""
    last = F.lag("ts").over(W.ordered(["user_id"], ["ts", "event_id"]))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 - F.unix_micros(last.cast("timestamp")) / 1e6
    return t("events").select("event_id", F.rint(seconds).cast("long").alias("seconds_since_last"))


@query("""
WITH d AS (SELECT c_nationkey AS nation, CAST(o_orderdate AS DATE) AS day, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k
  FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
w AS (SELECT a.nation, a.day, sum(b.n) AS n, sum(b.k) AS k FROM d a LEFT JOIN d b ON b.nation = a.nation AND b.day BETWEEN a.day - 90 AND a.day - 1 GROUP BY 1, 2)
SELECT nation, day, CAST(coalesce(n, 0) AS BIGINT) AS n_90d, round(k / nullif(CAST(n AS DOUBLE), 0), 6) AS rate_90d FROM w
""")
def trailing_90d_rate(t):
    """Per nation and day over the 90 days before, which is windowed over daily sums."""
    o = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    d = o.groupBy(F.col("c_nationkey").alias("nation"), F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    w = W.trailing_days(["nation"], "day", 90, 1)
    d = d.withColumns({"nn": F.sum("n").over(w), "kk": F.sum("k").over(w)})
    return d.select("nation", "day", F.coalesce("nn", F.lit(0)).alias("n_90d"), r(shrink.ratio(F.col("kk"), F.col("nn"))).alias("rate_90d"))


@query("""
SELECT event_id, count(*) OVER w AS events_so_far, CAST(sum(first_kind) OVER w AS BIGINT) AS kinds_so_far, round(sum(value) OVER w, 4) AS value_so_far,
  count(CASE WHEN event_type = 'purchase' THEN 1 END) OVER w AS purchases_so_far
FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) = 1 THEN 1 ELSE 0 END AS first_kind FROM events)
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def cumulative_role_timeline(t):
    w = W.upto(["user_id"], ["ts", "event_id"])
    e = W.running_distinct(t("events"), ["user_id"], "event_type", ["ts", "event_id"], "kinds_so_far", inclusive=True)
    return e.select("event_id", F.count(F.lit(1)).over(w).alias("events_so_far"), "kinds_so_far", r(F.sum("value").over(w), 4).alias("value_so_far"), F.count(F.when(F.col("event_type") == "purchase", 1)).over(w).alias("purchases_so_far"))


@query("""
SELECT event_id, count(*) OVER w AS pair_events, round(sum(value) OVER w, 4) AS pair_value
FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
""")
def pair_running_weight(t):
    w = W.upto(["user_id", "event_type"], ["ts", "event_id"])
    return t("events").select("event_id", F.count(F.lit(1)).over(w).alias("pair_events"), r(F.sum("value").over(w), 4).alias("pair_value"))


@query(f"""
SELECT o_orderkey, count(*) OVER w AS n_before, round(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER w AS DOUBLE) / nullif(count(*) OVER w, 0), 6) AS rate_before
FROM orders WINDOW w AS ({SQL_BEFORE})
""")
def global_running_rate(t):
    """Over the whole table in order, from sums by date, so that no task gets all rows."""
    o = W.running_total(t("orders"), "o_orderdate", "o_orderkey", {"n_before": F.lit(1), "k": positive()}, bucket=F.to_date("o_orderdate"))
    return o.select("o_orderkey", F.col("n_before").cast("long"), r(shrink.ratio(F.col("k"), F.col("n_before"))).alias("rate_before"))


@query("""
WITH p AS (SELECT p_partkey, p_brand, CAST(p_size AS DOUBLE) AS x FROM part)
SELECT p_partkey, round((sum(x) OVER (PARTITION BY p_brand) - x) / nullif(count(*) OVER (PARTITION BY p_brand) - 1, 0), 6) AS others FROM p
""")
def leave_one_out_mean(t):
    p = t("part").withColumn("x", F.col("p_size").cast("double"))
    return shrink.mean_of_others(p, ["p_brand"], "x", "others").select("p_partkey", r("others").alias("others"))


@query("""
SELECT DISTINCT o_custkey, o_orderdate, count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS n_upto FROM orders
""")
def peer_inclusive_count(t):
    return t("orders").select("o_custkey", "o_orderdate", F.count(F.lit(1)).over(W.peers(["o_custkey"], "o_orderdate")).alias("n_upto")).distinct()


@query("""
WITH f AS (SELECT e.*, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events e),
c AS (SELECT *, (CASE WHEN k > 1 THEN k * log2(k) ELSE 0 END) - (CASE WHEN k > 2 THEN (k - 1) * log2(k - 1) ELSE 0 END) AS d FROM f),
h AS (SELECT event_id, count(*) OVER w AS n, sum(d) OVER w AS x, sum(CASE WHEN k = 1 THEN 1 ELSE 0 END) OVER w AS kinds
  FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT event_id, CAST(kinds AS BIGINT) AS kinds, round(log2(n) - x / n, 5) AS entropy, round(CASE WHEN kinds > 1 THEN (log2(n) - x / n) / log2(kinds) ELSE 0 END, 5) AS entropy_norm FROM h WHERE n > 0
""")
def running_entropy(t):
    from tidemark.operators.entropy import running_entropy as run

    e = run(t("events"), ["user_id"], "event_type", ["ts", "event_id"], "h").where("h IS NOT NULL")
    return e.select("event_id", F.col("h_kinds").alias("kinds"), r("h", 5).alias("entropy"), r("h_norm", 5).alias("entropy_norm"))


_LINES_BEFORE = "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(f"""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, o_custkey, p_type, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS y
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey),
h AS (SELECT *, count(*) OVER a AS n, coalesce(sum(y) OVER a, 0) AS k, count(*) OVER b AS all_n, coalesce(avg(y) OVER c, 0.5) AS p FROM v
  WINDOW a AS (PARTITION BY o_custkey, p_type {_LINES_BEFORE}), b AS (PARTITION BY o_custkey {_LINES_BEFORE}), c AS (PARTITION BY p_type {_LINES_BEFORE}))
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n AS n_before, round(coalesce(CAST(k AS DOUBLE) / nullif(n, 0), 0), 6) AS rate_raw, round((15 * p + k) / (15 + n), 6) AS rate_shrunk,
  round(CAST(n AS DOUBLE) / nullif(all_n, 0), 6) AS focus FROM h
""")
def observer_taxon_shrunk(t):
    """Each customer's rate so far with a type, drawn towards the type's rate so far, and the share of their lines in it."""
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    v = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("part").select("p_partkey", "p_type"), F.col("p_partkey") == F.col("l_partkey"))
    v = W.running_totals(v.withColumn("y", (F.col("l_returnflag") == "A").cast("int")), ["p_type"], order, {"type_n": F.lit(1), "type_k": F.col("y")}, F.to_date("l_shipdate"))
    mine, theirs = W.before(["o_custkey", "p_type"], order), W.before(["o_custkey"], order)
    v = v.withColumns({"n": F.count(F.lit(1)).over(mine), "k": F.coalesce(F.sum("y").over(mine), F.lit(0)), "all_n": F.count(F.lit(1)).over(theirs)})
    prior = F.coalesce(shrink.ratio(F.col("type_k"), F.col("type_n")), F.lit(0.5))
    raw = F.coalesce(shrink.ratio(F.col("k"), F.col("n")), F.lit(0.0))
    return v.select(*order[1:], F.col("n").alias("n_before"), r(raw).alias("rate_raw"), r(shrink.shrunk(F.col("k"), F.col("n"), prior, 15)).alias("rate_shrunk"), r(shrink.ratio(F.col("n"), F.col("all_n"))).alias("focus"))
