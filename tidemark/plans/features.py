"""Feature groups, splits, the feature matrix and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.operators import evaluation, joins, shrink
from tidemark.operators import windows as W
from tidemark.plans import history, labels
from tidemark.plans.registry import ORACLES, query, r
from tidemark.sources import tables

ROLE = """
ev AS (SELECT o_custkey AS user_id, 'observer' AS role, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey, l_suppkey AS other, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey
  UNION ALL SELECT l_suppkey, 'identifier', l_shipdate, l_orderkey, l_linenumber, l_partkey, o_custkey, l_returnflag FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
tl AS (SELECT *, count(*) OVER w AS events, count(CASE WHEN l_returnflag = 'A' THEN 1 END) OVER w AS agree FROM ev
  WINDOW w AS (PARTITION BY user_id, role ORDER BY ts, l_orderkey, l_linenumber, l_partkey, other ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""
#: Lines received, those of them that agree, and lines given.
SUMS = ["x_n", "x_k", "y_n"]
#: What a row counts as: a line received, a line given, one more for lines that agree; 0 is an order.
RECEIVED, GIVEN = 1, 3


@query(f"""
WITH {ROLE}, a AS (SELECT user_id, role, ts, events, agree FROM tl
  QUALIFY row_number() OVER (PARTITION BY user_id, role, ts ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, other DESC) = 1)
SELECT o.o_orderkey, coalesce(x.events, 0) AS received, round((coalesce(x.agree, 0) + 10 * 0.33) / (coalesce(x.events, 0) + 10), 6) AS received_rate, coalesce(y.events, 0) AS given,
  round(CAST(coalesce(y.events, 0) AS DOUBLE) / nullif(x.events, 0), 6) AS reciprocity
FROM orders o ASOF LEFT JOIN (SELECT * FROM a WHERE role = 'observer') x ON x.user_id = o.o_custkey AND o.o_orderdate >= x.ts
  ASOF LEFT JOIN (SELECT * FROM a WHERE role = 'identifier') y ON y.user_id = o.o_custkey AND o.o_orderdate >= y.ts
""")
def role_features(t):
    """What a customer had received and given, in either role, as of each order: lines that aren't later, counted in one sequence of orders and both roles.

    A row of that sequence is a user, a time and what it counts as, dealt out by user and year once; then only orders and sums of years meet.
    """
    n = t("lineitem").count()
    agree, one, no = F.coalesce(F.col("l_returnflag") == "A", F.lit(False)), F.lit(1), F.lit(0)
    lines = tables.dealt(t("lineitem").where("l_shipdate IS NOT NULL").select("l_orderkey", "l_suppkey", "l_shipdate", agree.alias("agree")), n, "l_orderkey")
    v = lines.join(tables.dealt(t("orders").select("o_orderkey", "o_custkey"), n, "o_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    side = lambda user, role: F.struct(F.col(user).alias("user_id"), (F.lit(role) + F.col("agree").cast("int")).cast("byte").alias("counts"))
    each = F.explode(F.array(side("o_custkey", RECEIVED), side("l_suppkey", GIVEN))).alias("e")
    given = v.select(F.lit(None).cast("long").alias("o_orderkey"), F.col("l_shipdate").alias("ts"), each).select("o_orderkey", "ts", "e.*")
    asked = t("orders").select("o_orderkey", F.col("o_orderdate").alias("ts"), F.col("o_custkey").alias("user_id"), F.lit(0).cast("byte").alias("counts"))
    both = tables.dealt(given.unionByName(asked).withColumn("_b", F.year("ts")), 2 * n, "user_id", "_b")
    sums = [("x_n", [RECEIVED, RECEIVED + 1]), ("x_k", [RECEIVED + 1]), ("y_n", [GIVEN, GIVEN + 1])]
    both = both.withColumns({c: F.when(F.col("counts").isin(of), one).otherwise(no) for c, of in sums}).drop("counts")
    o = W.totals_asof(both, ["user_id"], "ts", SUMS, "_b", F.col("o_orderkey").isNotNull())
    received, given = F.coalesce("x_n", no).cast("long"), F.coalesce("y_n", no).cast("long")
    return o.select("o_orderkey", received.alias("received"), r(shrink.shrunk(F.col("x_k"), F.col("x_n"), F.lit(0.33), 10)).alias("received_rate"), given.alias("given"), r(shrink.ratio(given, F.col("x_n"))).alias("reciprocity"))


@query("""
WITH c AS (SELECT l_suppkey, p_type, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2), s AS (SELECT *, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY l_suppkey) AS p FROM c),
h AS (SELECT l_suppkey, -sum(p * ln(p + 1e-10)) AS h FROM s GROUP BY 1)
SELECT l_partkey, round(avg(h), 6) AS entropy_mean, count(*) AS votes, count(DISTINCT lineitem.l_suppkey) AS voters, round(CAST(count(CASE WHEN h >= 1.75 THEN 1 END) AS DOUBLE) / count(*), 6) AS share_general
FROM lineitem JOIN h ON h.l_suppkey = lineitem.l_suppkey GROUP BY 1 HAVING count(*) >= 6
""")
def specialist_signal(t):
    """How specialised the suppliers of each part are, over parts with six lines or more."""
    from tidemark.operators.entropy import group_entropy

    rows = t("lineitem").count()
    both = tables.dealt(t("lineitem").select("l_partkey", "l_suppkey"), rows, "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"))
    c = both.join(t("part"), F.col("p_partkey") == F.col("l_partkey")).groupBy("l_suppkey", "p_type").agg(F.sum("n").alias("n"))
    h = c.withColumn("p", F.col("n") / F.sum("n").over(W.whole(["l_suppkey"])).cast("double")).groupBy("l_suppkey").agg(group_entropy(F.col("p")).alias("h"))
    mean = F.sum(F.col("h") * F.col("n")) / F.sum("n").cast("double")
    g = both.join(h, "l_suppkey").groupBy("l_partkey").agg(mean.alias("m"), F.sum("n").alias("votes"), F.count("*").alias("voters"), F.sum(F.when(F.col("h") >= 1.75, F.col("n")).otherwise(0)).alias("k"))
    return g.where("votes >= 6").select("l_partkey", r("m").alias("entropy_mean"), "votes", "voters", r(shrink.ratio(F.col("k"), F.col("votes"))).alias("share_general"))


@query("""
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS k, count(DISTINCT o_custkey) AS users FROM orders GROUP BY 1),
w AS (SELECT a.day, sum(b.n) AS n, sum(b.k) AS k, sum(b.users) AS users FROM d a JOIN d b ON b.day BETWEEN a.day - 90 AND a.day - 1 GROUP BY 1)
SELECT o_orderkey, CAST(w.n AS BIGINT) AS n_90d, round(CAST(w.k AS DOUBLE) / w.n, 6) AS rate_90d, round(CAST(w.users AS DOUBLE) / w.n, 6) AS users_per_order FROM orders JOIN w ON w.day = CAST(o_orderdate AS DATE) + 7 WHERE w.n > 1
""")
def community_trailing(t):
    """The community's activity in the 90 days before a week after each order."""
    d = t("orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"), F.countDistinct("o_custkey").alias("users"))
    # one row for each day: the window is over days, not orders
    w = W.trailing_days([], "day", 90, 1)
    d = d.select("day", *(F.sum(c).over(w).alias(c) for c in ("n", "k", "users"))).where("n > 1")
    j = t("orders").withColumn("day", F.date_add(F.to_date("o_orderdate"), 7)).join(d, "day")
    return j.select("o_orderkey", F.col("n").alias("n_90d"), r(shrink.ratio(F.col("k"), F.col("n"))).alias("rate_90d"), r(shrink.ratio(F.col("users"), F.col("n"))).alias("users_per_order"))


CUTOFF, VAL, TEST = "1998-01-01", ("1998-02-01", "1999-06-01"), "1999-08-01"
SPLIT = f"""
s AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderdate < TIMESTAMP '{CUTOFF}' THEN 'train' WHEN o_orderdate >= TIMESTAMP '{VAL[0]}' AND o_orderdate < TIMESTAMP '{VAL[1]}' THEN 'val'
  WHEN o_orderdate >= TIMESTAMP '{TEST}' THEN 'test' END AS split FROM orders),
split AS (SELECT o_orderkey, split FROM s WHERE split IS NOT NULL QUALIFY split = 'train' OR row_number() OVER (PARTITION BY split ORDER BY o_orderdate, md5(CAST(o_orderkey AS VARCHAR))) <= 1000)
"""


@query(f"WITH {SPLIT} SELECT * FROM split")
def temporal_split(t):
    return evaluation.temporal_split(t("orders"), "o_orderdate", "o_orderkey", CUTOFF, VAL, TEST, 1000, 1000)


@query(f"""
WITH {SPLIT} SELECT split, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS positives, round(CAST(count(*) FILTER (o_orderstatus = 'F') AS DOUBLE) / count(*), 6) AS rate, min(o_orderdate) AS first, max(o_orderdate) AS last
FROM split JOIN orders ON orders.o_orderkey = split.o_orderkey GROUP BY 1
""")
def split_report(t):
    s = evaluation.temporal_split(t("orders"), "o_orderdate", "o_orderkey", CUTOFF, VAL, TEST, 1000, 1000).join(t("orders"), "o_orderkey")
    g = s.groupBy("split").agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("positives"), F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"))
    return g.select("split", "n", "positives", r(shrink.ratio(F.col("positives"), F.col("n"))).alias("rate"), "first", "last")


@query("""
WITH k AS (SELECT o_orderkey, o_orderdate, ntile(6) OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS chunk FROM orders), s AS (SELECT chunk, min(o_orderdate) AS start FROM k GROUP BY 1),
f AS (SELECT s.chunk AS fold, k.o_orderkey, CASE WHEN k.chunk = s.chunk THEN 'val' WHEN k.chunk < s.chunk AND k.o_orderdate < s.start - INTERVAL 30 DAY THEN 'train' END AS role FROM k JOIN s ON s.chunk >= greatest(k.chunk, 1))
SELECT fold, role, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM f WHERE role IS NOT NULL GROUP BY 1, 2
""")
def expanding_folds(t):
    f = evaluation.expanding_folds(t("orders"), "o_orderdate", "o_orderkey", 5, 30)
    return f.groupBy(F.col("fold").cast("long").alias("fold"), "role").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


SCORED = "sc AS (SELECT o_orderkey AS id, round(o_totalprice / (SELECT max(o_totalprice) FROM orders), 2) AS score, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y FROM orders)"


def scored(t):
    """A score with many ties, and the label."""
    top = t("orders").agg(F.max("o_totalprice").alias("top"))  # one row
    return t("orders").crossJoin(F.broadcast(top)).select(F.col("o_orderkey").alias("id"), F.round(F.col("o_totalprice") / F.col("top"), 2).alias("score"), history.positive().alias("y"))


SHARES = (0.005, 0.01, 0.05, 0.1, 0.2, 0.5)


@query(f"""
WITH {SCORED}, k AS (SELECT *, row_number() OVER w AS place, sum(y) OVER w AS hits FROM sc WINDOW w AS (ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), n AS (SELECT count(*) AS n, CAST(sum(y) AS DOUBLE) AS p FROM sc)
SELECT s * 100 AS k_pct, place AS n_reviewed, round(hits / p, 6) AS recall, round(CAST(hits AS DOUBLE) / place, 6) AS precision, round(CAST(hits AS DOUBLE) / place / (p / n), 6) AS lift
FROM (SELECT unnest([{", ".join(f"CAST({s} AS DOUBLE)" for s in SHARES)}]) AS s), n, k WHERE place = CAST(ceil(s * n) AS BIGINT)
""")
def ranking_curve(t):
    c = evaluation.curve_at(scored(t), SHARES, "score", "y", "id")
    return c.select("k_pct", "n_reviewed", r("recall").alias("recall"), r("precision").alias("precision"), r("lift").alias("lift"))


@query(f"""
WITH {SCORED}, g AS (SELECT score, count(*) AS n, sum(y) AS h FROM sc GROUP BY 1), c AS (SELECT *, sum(n) OVER w AS a, sum(h) OVER w AS b FROM g WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT round(sum(h * CAST(b AS DOUBLE) / a) / sum(h), 6) AS average_precision FROM c
""")
def average_precision(t):
    return evaluation.average_precision(scored(t), "score", "y").select(r("average_precision").alias("average_precision"))


@query(f"""
WITH {SCORED} SELECT CAST(least(floor(score * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS positive_rate, round(avg((score - y) ** 2), 6) AS brier FROM sc GROUP BY 1
""")
def brier_calibration(t):
    c = evaluation.calibration(scored(t), "score", "y", 10)
    return c.select("bin", "n", *(r(x).alias(x) for x in ("mean_score", "positive_rate", "brier")))


@query(f"""
WITH {SCORED}, g AS (SELECT score, count(*) AS n, sum(y) AS h FROM sc GROUP BY 1), c AS (SELECT *, sum(n - h) OVER (ORDER BY score) - (n - h) AS lower FROM g)
SELECT round(sum(h * (lower + 0.5 * (n - h))) / (sum(h) * CAST(sum(n - h) AS DOUBLE)), 6) AS roc_auc FROM c
""")
def roc_auc(t):
    return evaluation.roc_auc(scored(t), "score", "y").select(r("roc_auc").alias("roc_auc"))


@query(f"""
WITH {SCORED}, c AS (SELECT count(*) FILTER (score >= 0.3 AND y = 1) AS tp, count(*) FILTER (score >= 0.3 AND y = 0) AS fp, count(*) FILTER (score < 0.3 AND y = 0) AS tn, count(*) FILTER (score < 0.3 AND y = 1) AS fn FROM sc),
s AS (SELECT 0 AS class, tn AS hit, fn AS wrong, fp AS missed FROM c UNION ALL SELECT 1, tp, fp, fn FROM c)
SELECT class, round(hit / (hit + wrong), 6) AS precision, round(hit / (hit + missed), 6) AS recall, round(2 * hit / (2 * hit + wrong + missed), 6) AS f1, hit + missed AS support, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM s, c
""")
def classification_report(t):
    g = evaluation.report(scored(t), "score", "y", 0.3)
    return g.select("class", *(r(c).alias(c) for c in ("precision", "recall", "f1")), "support", r("accuracy").alias("accuracy"))


@query(f"""
WITH {SCORED}, k AS (SELECT row_number() OVER w AS place, sum(y) OVER w AS hits FROM sc WINDOW w AS (ORDER BY score DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), n AS (SELECT count(*) AS n, sum(y) AS p FROM sc),
c AS (SELECT CAST(hits AS DOUBLE) / p AS recall, lead(CAST(hits AS DOUBLE) / p) OVER (ORDER BY place) AS next, n FROM k, n)
SELECT round(sum((recall + next) / 2 / n), 6) AS recall_area FROM c
""")
def recall_area(t):
    return evaluation.recall_area(scored(t), "score", "y", "id").select(r("recall_area").alias("recall_area"))


@query(f"""
WITH {SCORED}, k AS (SELECT y, row_number() OVER (ORDER BY score DESC, id) AS place FROM sc)
SELECT count(*) AS n_reviewed, round(avg(y), 6) AS precision FROM k WHERE place <= (SELECT floor(0.05 * count(*)) FROM sc)
""")
def precision_at_share(t):
    return evaluation.precision_at(scored(t), 0.05, "score", "y", "id").select("n_reviewed", r("precision").alias("precision"))


TARGETS = (0.48, 0.52)


@query(f"""
WITH {SCORED}, g AS (SELECT score, count(*) AS n, sum(y) AS h FROM sc GROUP BY 1), c AS (SELECT score, CAST(sum(h) OVER w AS DOUBLE) / sum(n) OVER w AS p, CAST(sum(h) OVER w AS DOUBLE) / (SELECT sum(y) FROM sc) AS q FROM g WINDOW w AS (ORDER BY score DESC)),
t AS (SELECT unnest([{", ".join(f"CAST({x} AS DOUBLE)" for x in TARGETS)}]) AS target)
SELECT target, score AS threshold, round(p, 6) AS precision, round(q, 6) AS recall FROM t, c QUALIFY row_number() OVER (PARTITION BY target ORDER BY round(abs(p - target), 12), score) = 1
""")
def operating_points(t):
    """The thresholds with a precision nearest to each target."""
    return evaluation.operating_points(scored(t), TARGETS, "score", "y").select("target", "threshold", r("precision").alias("precision"), r("recall").alias("recall"))


@query("""
SELECT round(corr(l_quantity, l_extendedprice), 6) AS quantity_price, round(corr(l_quantity, l_discount), 6) AS quantity_discount, round(corr(l_extendedprice, l_tax), 6) AS price_tax FROM lineitem
""")
def feature_correlation(t):
    pairs = {"quantity_price": ("l_quantity", "l_extendedprice"), "quantity_discount": ("l_quantity", "l_discount"), "price_tax": ("l_extendedprice", "l_tax")}
    return t("lineitem").agg(*(r(F.corr(a, b)).alias(n) for n, (a, b) in pairs.items()))


def matrix(t):
    """One row for each order of a split: its customer's history, season, roles, community and agreed level, with the label."""
    o = history.with_history(t).withColumns({"k": F.col("positives_before"), "prior": F.col("p"), "price_before": r(F.avg("o_totalprice").over(W.before(*history.BY_CUSTOMER)), 4)})
    week = times.cyclic(F.weekofyear("o_orderdate"), 52)
    o = o.select(
        "o_orderkey", "o_totalprice", "n_before", r("prior").alias("prior"), r(shrink.shrunk(F.col("k"), F.col("n_before"), F.col("prior"), 10)).alias("rate_before"), "price_before",
        r(F.log10(F.col("n_before") + 1)).alias("n_log"), r(week[0]).alias("week_sin"), r(week[1]).alias("week_cos"), "y",
    )
    split = evaluation.temporal_split(t("orders"), "o_orderdate", "o_orderkey", CUTOFF, VAL, TEST, 1000, 1000)
    level = labels.levels(t).select(F.col("item").alias("o_orderkey"), F.col("level").alias("agreed_level"))
    return o.join(split, "o_orderkey").join(role_features.of(t), "o_orderkey", "left").join(community_trailing.of(t), "o_orderkey", "left").join(level, "o_orderkey", "left")


@query(f"""
WITH {labels.VOTES}, {labels.agreed_sql(labels.HORIZON)}, {SPLIT}, h AS ({ORACLES["observer_history_shrunk"]}), rf AS ({ORACLES["role_features"]}), ct AS ({ORACLES["community_trailing"]}),
x AS (SELECT o_orderkey, o_totalprice, o_orderstatus, o_orderdate, round(avg(o_totalprice) OVER (PARTITION BY o_custkey {history.SQL_BEFORE}), 4) AS price_before FROM orders)
SELECT x.o_orderkey, o_totalprice, n_before, prior, rate_shrunk AS rate_before, price_before, round(log10(n_before + 1), 6) AS n_log, round(sin(2 * pi() * week(o_orderdate) / 52), 6) AS week_sin,
  round(cos(2 * pi() * week(o_orderdate) / 52), 6) AS week_cos, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS y, split.split, received, received_rate, given, reciprocity, n_90d, rate_90d, users_per_order, level AS agreed_level
FROM x JOIN split ON split.o_orderkey = x.o_orderkey JOIN h ON h.o_orderkey = x.o_orderkey LEFT JOIN rf ON rf.o_orderkey = x.o_orderkey LEFT JOIN ct ON ct.o_orderkey = x.o_orderkey LEFT JOIN agreed ON item = x.o_orderkey
""")
def training_matrix(t):
    return matrix(t)
