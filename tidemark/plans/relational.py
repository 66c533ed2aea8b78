"""Joins, set operations and aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import entropy, joins, running, shrink
from tidemark.operators import windows as W
from tidemark.plans.registry import query, r
from tidemark.sources import tables

#: The classes of a supplier's entropy (upper bounds), the least rows of a level that can be a prior, the prior's weight
#: and the rows below which a node counts as new.
ENTROPY_CLASSES = ((0.0001, "pure"), (0.5, "near"), (2.0, "mixed"))
LEAST_GENUS, LEAST_FAMILY, LEAST_ORDER, PRIOR_WEIGHT, COLD = 20, 50, 500, 5, 6


@query("""
WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), v AS (SELECT * FROM events WHERE event_type = 'view')
SELECT p.event_id, v.event_id AS view_id, v.value AS view_value FROM p JOIN v ON v.user_id = p.user_id AND v.ts <= p.ts
QUALIFY row_number() OVER (PARTITION BY p.event_id ORDER BY v.ts DESC, v.event_id DESC) = 1
""")
def asof_last_event(t):
    """Each purchase with the user's last view until then."""
    e = t("events")
    views = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    found = joins.asof_join(e.where("event_type = 'purchase'"), views, ["user_id"], "ts", "ts", ["view_id", "view_value"], ["view_id"])
    return found.select("event_id", "view_id", "view_value")


@query("""
SELECT o_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS voters FROM orders JOIN lineitem ON l_orderkey = o_orderkey
AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 365 DAY GROUP BY 1
""")
def interval_join_window(t):
    end = F.col("o_orderdate") + F.make_dt_interval(F.lit(365))
    j = t("orders").join(t("lineitem"), (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")) & (F.col("l_shipdate") <= end))
    return j.groupBy("o_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("voters"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')")
def anti_join_missing(t):
    return tables.missing(t("customer").select("c_custkey"), t("orders").where("o_orderstatus = 'F'"), "c_custkey", "o_custkey")


@query("SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 49)")
def semi_join_in(t):
    few = t("lineitem").where("l_quantity >= 49").select(F.col("l_partkey").alias("p_partkey"))
    return tables.kept_in(t("part").select("p_partkey", "p_brand"), few, "p_partkey")


@query("""
WITH d AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem)
SELECT a.l_orderkey, a.l_suppkey AS one, b.l_suppkey AS other FROM d a JOIN d b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey
""")
def self_join_pairs(t):
    d = t("lineitem").select("l_orderkey", "l_suppkey").distinct()
    return d.withColumnRenamed("l_suppkey", "one").join(d.withColumnRenamed("l_suppkey", "other"), "l_orderkey").where("one < other")


@query("""
WITH w AS (SELECT c_nationkey AS nation, week(o_orderdate) AS week, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
k AS (SELECT DISTINCT nation FROM w)
SELECT k.nation, s.week, coalesce(w.n, 0) AS n FROM k CROSS JOIN (SELECT unnest(range(1, 54)) AS week) s LEFT JOIN w ON w.nation = k.nation AND w.week = s.week
""")
def dense_matrix_fill(t):
    o = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    w = o.groupBy(F.col("c_nationkey").alias("nation"), F.weekofyear("o_orderdate").alias("week")).agg(F.count("*").alias("n"))
    return joins.dense(w, ["nation"], "week", 1, 53, ["n"]).select("nation", F.col("week").cast("long"), "n")


@query("""
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1)
SELECT o_orderkey, d.n AS orders_a_week_later FROM orders JOIN d ON d.day = CAST(o_orderdate AS DATE) + 7
""")
def date_key_join(t):
    d = t("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("orders_a_week_later"))
    return t("orders").withColumn("day", F.date_add(F.to_date("o_orderdate"), 7)).join(d, "day").select("o_orderkey", "orders_a_week_later")


@query("""
WITH n AS (SELECT 'type' AS rank, p_type AS name, min(p_partkey) AS id FROM part GROUP BY 2 UNION ALL SELECT 'brand', p_brand, min(p_partkey) FROM part GROUP BY 2)
SELECT p.p_partkey, a.id AS type_id, b.id AS brand_id FROM part p LEFT JOIN n a ON a.rank = 'type' AND a.name = p.p_type LEFT JOIN n b ON b.rank = 'brand' AND b.name = p.p_brand
""")
def rank_self_lookup(t):
    p = t("part")
    names = p.groupBy(F.lit("type").alias("rank"), F.col("p_type").alias("name")).agg(F.min("p_partkey").alias("id")).unionByName(p.groupBy(F.lit("brand").alias("rank"), F.col("p_brand").alias("name")).agg(F.min("p_partkey").alias("id")))
    found = joins.lookup_by_rank(p, names, {"type": "p_type", "brand": "p_brand"}, "rank", "name", "id")
    return found.select("p_partkey", F.col("p_type_id").alias("type_id"), F.col("p_brand_id").alias("brand_id"))


@query("SELECT c_nationkey AS node FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct_nodes(t):
    return t("customer").select(F.col("c_nationkey").alias("node")).union(t("supplier").select("s_nationkey")).distinct()


@query("""
WITH v AS (SELECT o_custkey, l_suppkey, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT role, user_id, count(*) AS events FROM (SELECT 'observer' AS role, o_custkey AS user_id FROM v UNION ALL SELECT 'identifier', l_suppkey FROM v) GROUP BY 1, 2
""")
def union_all_roles(t):
    """Each line counts once for its customer and once for its supplier."""
    n = t("lineitem").count()
    v = tables.dealt(t("lineitem").select("l_orderkey", "l_suppkey"), n, "l_orderkey").join(tables.dealt(t("orders").select("o_orderkey", "o_custkey"), n, "o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    side = lambda role, user: F.struct(F.lit(role).alias("role"), F.col(user).alias("user_id"))
    both = v.select(F.explode(F.array(side("observer", "o_custkey"), side("identifier", "l_suppkey"))).alias("e")).select("e.*")
    return both.groupBy("role", "user_id").agg(F.count("*").alias("events"))


@query("""
SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS agree, count(*) FILTER (l_returnflag = 'N') AS refine, count(*) FILTER (l_returnflag = 'R') AS maverick,
  max(l_discount > 0.09) AS any_steep, round(sum(l_quantity) FILTER (l_linestatus = 'O'), 2) AS open_quantity FROM lineitem GROUP BY 1
""")
def filtered_counts(t):
    kind = lambda c: F.count_if(F.col("l_returnflag") == c)
    return t("lineitem").groupBy("l_suppkey").agg(
        kind("A").alias("agree"), kind("N").alias("refine"), kind("R").alias("maverick"), F.max(F.col("l_discount") > 0.09).alias("any_steep"),
        r(F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity"))), 2).alias("open_quantity"),
    )


@query("SELECT o_custkey, count(*) AS n, round(CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS DOUBLE) / count(*), 6) AS share FROM orders GROUP BY 1 HAVING count(*) >= 6")
def conditional_share(t):
    g = t("orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    return g.where("n >= 6").select("o_custkey", "n", r(shrink.ratio(F.col("k"), F.col("n"))).alias("share"))


@query("""
WITH c AS (SELECT l_suppkey, p_type, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
s AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY l_suppkey) AS p, sum(n) OVER (PARTITION BY l_suppkey) AS total FROM c),
h AS (SELECT l_suppkey, -sum(p * ln(p + 1e-10)) AS h FROM s WHERE total > 5 GROUP BY 1)
SELECT l_suppkey, round(h, 5) AS entropy, CASE WHEN h <= 0.0001 THEN 'pure' WHEN h < 0.5 THEN 'near' WHEN h < 2.0 THEN 'mixed' ELSE 'general' END AS kind FROM h
""")
def group_entropy_class(t):
    """How widely each supplier spreads over types."""
    c = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("l_suppkey", "p_type").agg(F.count("*").alias("n"))
    w = W.whole(["l_suppkey"])
    c = c.withColumn("total", F.sum("n").over(w)).where("total > 5")
    h = c.groupBy("l_suppkey").agg(entropy.group_entropy(F.col("n") / F.col("total").cast("double")).alias("h"))
    (pure, one), (near, two), (mixed, three) = ENTROPY_CLASSES
    kind = F.when(F.col("h") <= pure, one).when(F.col("h") < near, two).when(F.col("h") < mixed, three).otherwise("general")
    return h.select("l_suppkey", r("h", 5).alias("entropy"), kind.alias("kind"))


@query("""
WITH c AS (SELECT l_suppkey, p_type, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2),
s AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY l_suppkey) AS p FROM c)
SELECT p_type, CAST(sum(n) AS BIGINT) AS total, round(CAST(coalesce(sum(n) FILTER (p >= 0.2), 0) AS DOUBLE) / sum(n), 6) AS by_concentrated FROM s GROUP BY 1
""")
def family_concentration(t):
    """The share of each type's lines that come from suppliers with a fifth of their lines in it."""
    c = t("lineitem").join(t("part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("l_suppkey", "p_type").agg(F.count("*").alias("n"))
    c = c.withColumn("p", F.col("n") / F.sum("n").over(W.whole(["l_suppkey"])).cast("double"))
    g = c.groupBy("p_type").agg(F.sum("n").alias("total"), F.coalesce(F.sum(F.when(F.col("p") >= 0.2, F.col("n"))), F.lit(0)).alias("k"))
    return g.select("p_type", "total", r(shrink.ratio(F.col("k"), F.col("total"))).alias("by_concentrated"))


@query("""
SELECT l_partkey, round(sum(l_quantity / nullif(l_linenumber, 0)) / sum(1.0 / nullif(l_linenumber, 0)), 6) AS mean_by_nearness,
  round(sum(l_quantity * l_linenumber) / sum(l_linenumber), 6) AS mean_by_distance FROM lineitem GROUP BY 1
""")
def inverse_distance_weighted(t):
    d, q = F.nullif(F.col("l_linenumber").cast("double"), F.lit(0.0)), F.col("l_quantity")
    return t("lineitem").groupBy("l_partkey").agg(r(F.sum(q / d) / F.sum(F.lit(1.0) / d)).alias("mean_by_nearness"), r(F.sum(q * F.col("l_linenumber")) / F.sum(F.col("l_linenumber").cast("double"))).alias("mean_by_distance"))


@query("SELECT l_suppkey, median(l_quantity) AS middle, round(stddev_samp(l_quantity), 4) AS spread, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY 1")
def median_stddev_group(t):
    q = "l_quantity"
    return t("lineitem").groupBy("l_suppkey").agg(F.median(q).alias("middle"), r(F.stddev_samp(q), 4).alias("spread"), F.min(q).alias("least"), F.max(q).alias("most"))


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate, o_totalprice, o_orderkey")
def argmin_row_per_key(t):
    return joins.first_row(t("orders"), ["o_custkey"], ["o_orderdate", "o_totalprice", "o_orderkey"], ["o_orderkey", "o_totalprice"])


BY_SHIPDATE = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
_BEFORE = "ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


@query(f"""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, p_brand, p_type, p_type[1] AS p_order, CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS y FROM lineitem JOIN part ON p_partkey = l_partkey),
h AS (SELECT *, count(*) OVER a AS n1, coalesce(sum(y) OVER a, 0) AS k1, count(*) OVER b AS n2, coalesce(sum(y) OVER b, 0) AS k2, count(*) OVER c AS n3, coalesce(sum(y) OVER c, 0) AS k3,
  count(*) OVER d AS n4, coalesce(sum(y) OVER d, 0) AS k4, avg(y) OVER ({_BEFORE}) AS overall FROM v
  WINDOW a AS (PARTITION BY l_partkey {_BEFORE}), b AS (PARTITION BY p_type, p_brand {_BEFORE}), c AS (PARTITION BY p_type {_BEFORE}), d AS (PARTITION BY p_order {_BEFORE})),
p AS (SELECT *, coalesce(CASE WHEN n2 >= 20 THEN CAST(k2 AS DOUBLE) / n2 WHEN n3 >= 50 THEN CAST(k3 AS DOUBLE) / n3 WHEN n4 >= 500 THEN CAST(k4 AS DOUBLE) / n4 END, overall, 0.5) AS prior,
  CASE WHEN n2 >= 20 THEN 1 WHEN n3 >= 50 THEN 2 WHEN n4 >= 500 THEN 3 ELSE 4 END AS source FROM h)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, n1 AS n_before, source AS prior_source, round(prior, 6) AS prior, round((5 * prior + k1) / (5 + n1), 6) AS rate, n1 < 6 AS cold FROM p
""")
def hierarchical_prior(t):
    """A part's rate so far, drawn towards that of its type and brand, else of its type, else of the types' initial, else of all.

    Parts are many, so theirs is a window; the other levels have few keys with many rows and are sums by day, all from one pass.
    """
    n = t("lineitem").count()
    lines = tables.dealt(t("lineitem").select(*BY_SHIPDATE, "l_returnflag"), n, "l_partkey")
    v = lines.join(t("part").select("p_partkey", "p_brand", "p_type"), F.col("p_partkey") == F.col("l_partkey"))
    v = v.select(*BY_SHIPDATE, "p_brand", "p_type", (F.col("l_returnflag") == "A").cast("int").alias("y"), F.substring("p_type", 1, 1).alias("p_order"))
    order = BY_SHIPDATE
    w = W.before(["l_partkey"], order)
    v = v.withColumns({"n1": F.count(F.lit(1)).over(w), "k1": F.coalesce(F.sum("y").over(w), F.lit(0))})
    levels = {"2": ["p_type", "p_brand", "p_order"], "3": ["p_type", "p_order"], "4": ["p_order"], "5": []}
    v = running.before(v, levels, order, F.to_date("l_shipdate"), {"y": F.col("y")}, stats=["n", "sum"], count=n)
    v = v.withColumns({f"{new}{k}": F.col(f"{k}_y_{old}") for k in levels for new, old in (("n", "n"), ("k", "sum"))})
    levels = [(F.col("k2"), F.col("n2"), LEAST_GENUS), (F.col("k3"), F.col("n3"), LEAST_FAMILY), (F.col("k4"), F.col("n4"), LEAST_ORDER)]
    prior, source = shrink.prior_of(levels, F.coalesce(shrink.ratio(F.col("k5"), F.col("n5")), F.lit(0.5)))
    rate = shrink.shrunk(F.col("k1"), F.col("n1"), prior, PRIOR_WEIGHT)
    return v.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("n1").alias("n_before"), source.alias("prior_source"), r(prior).alias("prior"), r(rate).alias("rate"), (F.col("n1") < COLD).alias("cold"))


@query(f"""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, ln(l_extendedprice) AS x, p_type, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {", ".join(f"count(x) OVER {w} AS {n}_n, round(avg(x) OVER {w}, 6) AS {n}_mean, round(max(x) OVER {w}, 6) AS {n}_max, round(stddev_samp(x) OVER {w}, 6) AS {n}_spread" for n, w in (("type", "a"), ("brand", "b")))}
FROM v WINDOW a AS (PARTITION BY p_type {_BEFORE}), b AS (PARTITION BY p_brand {_BEFORE})
""")
def running_levels(t):
    """Mean, maximum and deviation of the logarithms of prices so far of a part's type and of its brand: few keys, each with a large share of all lines."""
    v = t("lineitem").join(t("part").select("p_partkey", "p_brand", "p_type"), F.col("p_partkey") == F.col("l_partkey"))
    v = running.before(v, {"type": ["p_type"], "brand": ["p_brand"]}, BY_SHIPDATE, F.to_date("l_shipdate"), {"x": F.log("l_extendedprice")}, count=t("lineitem").count())
    each = lambda n: [F.col(f"{n}_x_n").alias(f"{n}_n"), r(running.mean(f"{n}_x")).alias(f"{n}_mean"), r(f"{n}_x_max").alias(f"{n}_max"), r(running.stddev(f"{n}_x")).alias(f"{n}_spread")]
    return v.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *each("type"), *each("brand"))


@query(f"""
WITH v AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice AS x, p_type, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(quantile_cont(x, 0.5) OVER (PARTITION BY p_type {_BEFORE}), 4) AS type_middle, round(quantile_cont(x, 0.5) OVER (PARTITION BY p_brand {_BEFORE}), 4) AS brand_middle FROM v
""")
def running_median_levels(t):
    """The median of the prices so far of a part's type and of its brand, exact though prices have as many values as rows."""
    lines = t("lineitem").select(*BY_SHIPDATE, "l_extendedprice")
    v = lines.join(t("part").select("p_partkey", "p_brand", "p_type"), F.col("p_partkey") == F.col("l_partkey")).drop("p_partkey")
    v = tables.materialized(v, "lines")
    of = lambda key, out, to=None: running.median(v, [key], BY_SHIPDATE, running.spans(v, [key], "l_shipdate"), "l_extendedprice", out, v if to is None else to)
    return of("p_brand", "b", of("p_type", "a")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r("a", 4).alias("type_middle"), r("b", 4).alias("brand_middle"))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderdate, o_orderkey) AS keys FROM orders GROUP BY 1")
def ordered_list_agg(t):
    from tidemark.functions import arrays

    keys = arrays.ordered_list(F.struct("o_orderdate", "o_orderkey"), F.col("o_orderkey").cast("string"))
    return t("orders").groupBy("o_custkey").agg(F.array_join(keys, ",").alias("keys"))
