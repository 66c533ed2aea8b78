"""Consensus of votes over a taxonomy, the labels from it, and how they settle."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import consensus, shrink
from tidemark.plans.registry import query, r
from tidemark.sources import tables

#: Item: order; vote: line; node: part, its type and brand, its type; created: when ordered; voted: when shipped.
HORIZON = 400

VOTES = """
v AS (SELECT o_orderkey AS item, o_orderdate AS created, l_shipdate AS time, l_linenumber * 100000000 + l_partkey AS vote, l_suppkey AS "user", 'p' || l_partkey AS leaf, 'g' || p_type || '|' || p_brand AS genus, 'f' || p_type AS family
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey WHERE l_shipdate >= o_orderdate)
"""


def agreed_sql(days: int | None, name: str = "agreed") -> str:
    end = "" if days is None else f"WHERE time <= created + INTERVAL {days} DAY"
    return f"""
{name}_v AS (SELECT * FROM v {end}),
{name}_c AS (SELECT DISTINCT item, leaf AS node, 10 AS level FROM {name}_v UNION SELECT item, genus, 20 FROM {name}_v UNION SELECT item, family, 30 FROM {name}_v),
{name}_t AS (SELECT c.item, c.node, c.level, v.time, sum(CASE WHEN c.node IN (v.leaf, v.genus, v.family) THEN 1 ELSE 0 END) OVER w AS supporters, count(*) OVER w AS total, v.vote, v."user"
  FROM {name}_c c JOIN {name}_v v ON v.item = c.item WINDOW w AS (PARTITION BY c.item, c.node ORDER BY v.time)),
{name} AS (SELECT item, node, level, time AS decided, CAST(supporters AS BIGINT) AS supporters, total, vote, "user" FROM {name}_t WHERE 3 * supporters >= 2 * total AND supporters >= 2
  QUALIFY row_number() OVER (PARTITION BY item ORDER BY level, time, node, vote, "user") = 1)
"""


def votes(t):
    """Lines as votes on their orders, dealt out by order; paths are made after that, so that they aren't shuffled."""
    n = t("lineitem").count()
    lines = t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").join(t("part").select("p_partkey", "p_type", "p_brand"), F.col("p_partkey") == F.col("l_partkey"))
    items = tables.dealt(t("orders").select("o_orderkey", "o_orderdate"), n, "o_orderkey")
    v = tables.dealt(lines, n, "l_orderkey").join(items, F.col("o_orderkey") == F.col("l_orderkey")).where("l_shipdate >= o_orderdate")
    node = lambda x, level: F.struct(x.alias("node"), F.lit(level).alias("level"))
    path = F.array(node(F.concat(F.lit("p"), F.col("l_partkey").cast("string")), 10), node(F.concat(F.lit("g"), "p_type", F.lit("|"), "p_brand"), 20), node(F.concat(F.lit("f"), "p_type"), 30))
    return v.select(F.col("o_orderkey").alias("item"), F.col("o_orderdate").alias("created"), F.col("l_shipdate").alias("time"), path.alias("path"), (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey")).alias("vote"), F.col("l_suppkey").alias("user"))


def steps(t):
    return consensus.decisive(votes(t), least=consensus.LEAST)


def levels(t):
    """(item, level) of what is agreed on: whose votes these are isn't asked, so it isn't shuffled."""
    v = votes(t).withColumns({"vote": F.lit(0), "user": F.lit(0)})
    return consensus.at(consensus.decisive(v, least=consensus.LEAST), HORIZON).select("item", "level")


@query(f"WITH {VOTES}, {agreed_sql(HORIZON)} SELECT * FROM agreed")
def consensus_windowed(t):
    return consensus.at(steps(t), HORIZON)


#: An order submits the type and brand of its first line, nothing if that was returned.
LABELS = """
own AS (SELECT l_orderkey, arg_min(CASE WHEN l_returnflag = 'R' THEN 'nothing' ELSE 'g' || p_type || '|' || p_brand END, (l_linenumber, l_partkey, l_suppkey, l_returnflag)) AS first FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
l AS (SELECT o_orderkey AS item, o_orderdate AS created, o_custkey, o_totalprice > 0 AND coalesce(agreed.level <= 20, FALSE) AND coalesce(agreed.node = nullif(own.first, 'nothing'), TRUE) AS is_positive, agreed.decided, agreed.node, agreed.level
  FROM orders LEFT JOIN agreed ON agreed.item = o_orderkey LEFT JOIN own ON l_orderkey = o_orderkey)
"""


def labelled(t, days=HORIZON):
    """Orders with the node that is agreed on and whether it is specific and the submitted one."""
    items = t("orders").select(F.col("o_orderkey").alias("item"), F.col("o_orderdate").alias("created"), "o_custkey", "o_totalprice", "o_orderstatus")
    lines = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey"))
    own = lines.groupBy(F.col("l_orderkey").alias("item")).agg(F.min_by(F.struct("l_returnflag", F.concat(F.lit("g"), "p_type", F.lit("|"), "p_brand").alias("kind")), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")).alias("first"))
    own = own.select("item", F.when(F.col("first.l_returnflag") != "R", F.col("first.kind")).alias("submitted"))
    return consensus.label(items.join(own, "item", "left"), consensus.at(steps(t), days), "submitted", F.col("o_totalprice") > 0, specific=20)


@query(f"""
WITH {VOTES}, {agreed_sql(HORIZON)}, {LABELS}
SELECT item, is_positive, CASE WHEN is_positive THEN CAST(date_part('day', decided - created) AS BIGINT) END AS days_to_positive, coalesce(level <= 20, FALSE) AND NOT is_positive AS disagrees FROM l
""")
def label_windowed(t):
    """Also whether a specific node is agreed on that isn't the submitted one."""
    other = F.coalesce(F.col("level") <= 20, F.lit(False)) & ~F.col("is_positive")
    return labelled(t).select("item", "is_positive", "days_to_positive", other.alias("disagrees"))


SETTLE = (30, 90, 180, 365, 730)


@query(f"WITH {VOTES}, {', '.join(agreed_sql(d, f'a{d}') for d in SETTLE)} " + " UNION ALL ".join(f"SELECT {d} AS days, count(*) AS agreed, count(*) FILTER (level = 10) AS specific FROM a{d}" for d in SETTLE))
def settlement_curve(t):
    """All horizons from one timeline, in one pass."""
    found = consensus.at_each(steps(t), SETTLE).groupBy("days").agg(F.count("*").alias("agreed"), F.count_if(F.col("level") == 10).alias("specific"))
    each = found.sparkSession.createDataFrame([(d,) for d in SETTLE], "days int")
    return each.join(found, "days", "left").fillna(0)


@query(f"""
WITH {VOTES}, {agreed_sql(HORIZON)}, {LABELS}
SELECT count(*) FILTER (is_positive AND o_orderstatus = 'F') AS tp, count(*) FILTER (is_positive AND o_orderstatus <> 'F') AS fp, count(*) FILTER (NOT is_positive AND o_orderstatus <> 'F') AS tn,
  count(*) FILTER (NOT is_positive AND o_orderstatus = 'F') AS fn FROM l JOIN orders ON o_orderkey = item
""")
def label_confusion_matrix(t):
    p, f = F.col("is_positive"), F.col("o_orderstatus") == "F"
    return labelled(t).agg(F.count_if(p & f).alias("tp"), F.count_if(p & ~f).alias("fp"), F.count_if(~p & ~f).alias("tn"), F.count_if(~p & f).alias("fn"))


@query("""
WITH v AS (SELECT o_orderkey, o_orderdate, o_custkey, l_suppkey, l_shipdate, l_returnflag, l_partkey, l_linenumber FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 365 DAY),
f AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate, l_partkey, l_suppkey, l_linenumber) AS k FROM v)
SELECT o_orderkey, count(l_suppkey) AS n, count(DISTINCT l_suppkey) AS voters, round(count(l_suppkey) / 365.0, 4) AS velocity, count(l_suppkey) > 0 AS has_any,
  max(CASE WHEN k = 1 AND l_suppkey IS NOT NULL THEN CAST(date_part('day', l_shipdate - o_orderdate) AS BIGINT) END) AS first_after_days, max(CASE WHEN k = 1 AND l_suppkey IS NOT NULL THEN l_returnflag END) AS first_kind,
  round(coalesce(count(*) FILTER (l_returnflag = 'A') / nullif(CAST(count(l_suppkey) AS DOUBLE), 0), 0), 6) AS share_agree FROM f GROUP BY 1
""")
def identification_dynamics(t):
    """Votes within a year: number, voters, pace, the first one, shares of kinds."""
    end = F.col("o_orderdate") + F.make_dt_interval(F.lit(365))
    v = t("orders").join(t("lineitem"), (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") <= end), "left")
    first = F.min_by(F.struct("l_shipdate", "l_returnflag"), F.when(F.col("l_suppkey").isNotNull(), F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber"))).alias("first")
    g = v.groupBy("o_orderkey", "o_orderdate").agg(F.count("l_suppkey").alias("n"), F.countDistinct("l_suppkey").alias("voters"), F.count_if(F.col("l_returnflag") == "A").alias("agree"), first)
    return g.select(
        "o_orderkey", "n", "voters", r(F.col("n") / 365.0, 4).alias("velocity"), (F.col("n") > 0).alias("has_any"), F.timestamp_diff("DAY", F.col("o_orderdate"), F.col("first.l_shipdate")).alias("first_after_days"),
        F.col("first.l_returnflag").alias("first_kind"), r(F.coalesce(shrink.ratio(F.col("agree"), F.col("n")), F.lit(0.0))).alias("share_agree"),
    )
