"""Dates, JSON, arrays and histograms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import arrays, structs, times
from tidemark.operators import joins
from tidemark.plans.registry import query, r
from tidemark.sources import tables


@query("""
SELECT o_orderkey, round(sin(2 * pi() * week(o_orderdate) / 52), 6) AS week_sin, round(cos(2 * pi() * week(o_orderdate) / 52), 6) AS week_cos,
  round(sin(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month(o_orderdate) / 12), 6) + 0.0 AS month_cos FROM orders
""")
def cyclic_time_encoding(t):
    week, month = times.cyclic(F.weekofyear("o_orderdate"), 52), times.cyclic(F.month("o_orderdate"), 12)
    return t("orders").select("o_orderkey", *(r(c).alias(f"week_{n}") for c, n in zip(week, ("sin", "cos"), strict=True)), *((r(c) + 0.0).alias(f"month_{n}") for c, n in zip(month, ("sin", "cos"), strict=True)))


@query("""
WITH e AS (SELECT event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last FROM events)
SELECT event_id, CAST(date_part('day', ts - last) AS BIGINT) AS days, CAST(date_part('hour', ts - last) AS BIGINT) AS hours, CAST(year(ts) AS BIGINT) AS y, CAST(week(ts) AS BIGINT) AS w FROM e
""")
def day_hour_parts(t):
    from tidemark.operators import windows as W

    e = t("events").withColumn("last", F.lag("ts").over(W.ordered(["user_id"], ["ts", "event_id"])))
    last, ts = F.col("last"), F.col("ts")
    return e.select("event_id", times.days_between(last, ts).alias("days"), times.hour_part(last, ts).alias("hours"), F.year("ts").cast("long").alias("y"), F.weekofyear("ts").cast("long").alias("w"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_typed(t):
    return tables.typed_json(t("events"), "props", "k bigint", "j").select("event_id", "j.k")


@query("""
WITH s AS (SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%d/%m/%Y %H:%M:%S') ELSE 'no date' END AS text FROM events)
SELECT event_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS seconds FROM s
""")
def timestamp_parse_cascade(t):
    text = F.when(F.col("event_id") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("event_id") % 3 == 1, F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).otherwise("no date")
    found = times.parsed(F.col("text"), "yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy HH:mm:ss")
    return t("events").withColumn("text", text).select("event_id", F.unix_seconds(found).alias("seconds"))


def slot_vectors(df, key: str, slot, first: int, last: int):
    """(key, counts): how many rows of each key fall in each slot from first to last; key and slot are any columns."""
    w = df.groupBy(key, slot.alias("slot")).agg(F.count("*").alias("n"))
    return joins.dense(w, [key], "slot", first, last, ["n"]).groupBy(key).agg(arrays.ordered_list(F.col("slot"), F.col("n")).alias("counts"))


def week_vectors(t):
    """(nation, counts): how many orders of each nation fall in each of 53 weeks."""
    o = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey"))
    return slot_vectors(o.withColumnRenamed("c_nationkey", "nation"), "nation", F.weekofyear("o_orderdate"), 1, 53)


WEEKS = """
w AS (SELECT c_nationkey AS nation, week(o_orderdate) AS week, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
dense AS (SELECT k.nation, s.week, coalesce(w.n, 0) AS n FROM (SELECT DISTINCT nation FROM w) k CROSS JOIN (SELECT unnest(range(1, 54)) AS week) s
  LEFT JOIN w ON w.nation = k.nation AND w.week = s.week),
world AS (SELECT week, sum(n) AS n FROM dense GROUP BY 1),
pmf AS (SELECT d.nation, d.week, d.n + 100.0 * (CAST(x.n AS DOUBLE) / (SELECT sum(n) FROM world)) AS v FROM dense d JOIN world x ON x.week = d.week),
p AS (SELECT nation, week, v / sum(v) OVER (PARTITION BY nation) AS p FROM pmf)
"""


@query(f"WITH {WEEKS} SELECT nation, string_agg(CAST(n AS VARCHAR), ',' ORDER BY week) AS counts FROM dense GROUP BY 1")
def week_histogram(t):
    return week_vectors(t).select("nation", F.array_join(F.transform("counts", lambda n: n.cast("string")), ",").alias("counts"))


def blended_weeks(t):
    """(nation, counts, p): each nation's weeks blended with the world's at weight 100."""
    v = week_vectors(t)
    world = v.select(F.posexplode("counts").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).agg(arrays.ordered_list(F.col("k"), F.col("n")).alias("world"))
    return v.crossJoin(F.broadcast(world)).withColumn("p", arrays.blended(F.col("counts"), F.col("world"), 100))  # world is one row of 53 numbers


@query(f"WITH {WEEKS} SELECT nation, week, round(p, 6) AS p FROM p")
def blended_histogram(t):
    return blended_weeks(t).select("nation", F.posexplode("p").alias("k", "p")).select("nation", (F.col("k") + 1).cast("long").alias("week"), r("p").alias("p"))


@query(f"""
WITH {WEEKS}, m AS (SELECT nation, sum(p * week) AS mu, max(p) AS top FROM p GROUP BY 1),
c AS (SELECT p.nation, any_value(mu) AS mu, sum(p * (week - mu) ** 2) AS m2, sum(p * (week - mu) ** 4) AS m4, min(week) FILTER (p = top) AS peak, count(*) FILTER (p >= 0.8 * top) AS width
  FROM p JOIN m ON m.nation = p.nation GROUP BY 1)
SELECT nation, round(mu, 4) AS mean_week, round(m2, 3) AS variance, round(m4 / (m2 * m2) - 3, 4) AS excess_kurtosis, peak AS peak_week, width AS season_width, CAST(ceil(peak / 4.0) AS BIGINT) AS peak_month FROM c
""")
def histogram_moments(t):
    b = blended_weeks(t).withColumn("mu", arrays.mean_place(F.col("p"))).withColumn("top", F.array_max("p"))
    b = b.withColumns({"m2": arrays.central_moment(F.col("p"), F.col("mu"), 2), "m4": arrays.central_moment(F.col("p"), F.col("mu"), 4), "peak": F.array_position("p", F.col("top"))})
    return b.select(
        "nation", r("mu", 4).alias("mean_week"), r("m2", 3).alias("variance"), r(F.col("m4") / (F.col("m2") * F.col("m2")) - 3, 4).alias("excess_kurtosis"), F.col("peak").alias("peak_week"),
        F.size(F.filter("p", lambda v: v >= 0.8 * F.col("top"))).cast("long").alias("season_width"), F.ceil(F.col("peak") / 4.0).cast("long").alias("peak_month"),
    )


@query(f"""
WITH {WEEKS}, q AS (SELECT week, CAST(n AS DOUBLE) / (SELECT sum(n) FROM world) AS q FROM world)
SELECT nation, round(sum((p + 1e-10) * ln((p + 1e-10) / (q + 1e-10))), 6) AS divergence, round(sum(p * q) / (sqrt(sum(p * p)) * sqrt(sum(q * q))), 6) AS cosine, round(sqrt(sum((p - q) * (p - q))), 6) AS distance
FROM p JOIN q ON q.week = p.week GROUP BY 1
""")
def kl_cosine_l2(t):
    b = blended_weeks(t).withColumn("q", F.transform("world", lambda n: n / arrays.total(F.col("world"))))
    p, q = F.col("p"), F.col("q")
    return b.select("nation", r(arrays.divergence(p, q)).alias("divergence"), r(arrays.cosine(p, q)).alias("cosine"), r(arrays.distance(p, q)).alias("distance"))


@query(f"""
WITH {WEEKS}, k AS (SELECT nation, min(week) AS peak FROM (SELECT *, max(n) OVER (PARTITION BY nation) AS top FROM dense) WHERE n = top GROUP BY 1),
z AS (SELECT min(week) AS peak FROM world WHERE n = (SELECT max(n) FROM world)), l AS (SELECT k.nation, ((k.peak - z.peak) % 52 + 52) % 52 AS lag FROM k, z)
SELECT nation, CASE WHEN lag > 26 THEN lag - 52 ELSE lag END AS peak_lag FROM l
""")
def circular_peak_lag(t):
    b = blended_weeks(t)
    peak = lambda c: F.array_position(c, F.array_max(c))
    return b.select("nation", arrays.circular_lag(peak("counts"), peak("world"), 52).cast("long").alias("peak_lag"))


@query("SELECT o_orderkey AS item, l_linenumber AS vote_line, l_suppkey AS vote_user, l_returnflag AS vote_kind, l_quantity AS vote_weight FROM orders JOIN lineitem ON l_orderkey = o_orderkey")
def struct_list_flatten(t):
    """Votes nested as a list of structs in each item, then taken apart again."""
    vote = F.struct(F.col("l_linenumber").alias("line"), F.struct(F.col("l_suppkey").alias("id"), F.col("l_quantity").alias("weight")).alias("user"), F.col("l_returnflag").alias("kind"))
    nested = t("lineitem").groupBy(F.col("l_orderkey").alias("item")).agg(F.collect_list(vote).alias("votes"))
    e = nested.select("item", F.explode("votes").alias("v"))
    return e.select("item", F.col("v.line").alias("vote_line"), F.col("v.user.id").alias("vote_user"), F.col("v.kind").alias("vote_kind"), F.col("v.user.weight").alias("vote_weight"))


@query("""
SELECT event_type, string_agg(CAST(n AS VARCHAR), ',' ORDER BY slot) AS counts FROM (SELECT k.event_type, slot, count(e.event_id) AS n FROM (SELECT DISTINCT event_type FROM events) k CROSS JOIN (SELECT unnest(range(0, 24)) AS slot)
  LEFT JOIN events e ON e.event_type = k.event_type AND hour(e.ts) = slot GROUP BY 1, 2) GROUP BY 1
""")
def hour_histogram(t):
    """The same histogram by another key and slot."""
    v = slot_vectors(t("events"), "event_type", F.hour("ts"), 0, 23)
    return v.select("event_type", F.array_join(F.transform("counts", lambda n: n.cast("string")), ",").alias("counts"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS first_value, 'k=' || CAST(json_extract(props, '$.k') AS BIGINT) AS entries, 1 AS entries_n, CAST(json_extract(props, '$.k') AS BIGINT) AS total FROM events")
def map_functions(t):
    """Keys, values and entries of a map read from JSON, and a histogram from it."""
    m = t("events").withColumn("m", F.from_json("props", "map<string,bigint>"))
    entries = F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    by_number = arrays.histogram(F.map_from_arrays(F.transform(F.map_keys("m"), F.length), F.map_values("m")), 1, 3)
    return m.select("event_id", F.element_at(F.map_values("m"), 1).alias("first_value"), F.array_join(entries, ",").alias("entries"), F.size("m").alias("entries_n"), F.aggregate(by_number, F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("""
SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) + 14400 WHEN 3 THEN NULL ELSE CAST(epoch(date_trunc('second', ts)) AS BIGINT) END AS seconds FROM events
""")
def timestamp_zones(t):
    """Times with an offset, with a zone, without either, and none."""
    plain = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(plain, F.lit(" -0400"))).when(k == 1, F.concat(plain, F.lit(" UTC"))).when(k == 2, plain).otherwise("no date")
    return t("events").select("event_id", F.unix_seconds(times.zoned(text)).alias("seconds"))


@query("""
SELECT o_orderkey AS id, c_custkey AS id_1, n_nationkey AS id_2, n_name AS name, c_name AS name_1, o_orderstatus AS status FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
""")
def recursive_flatten(t):
    """Structs in structs as columns, with numbers behind names that clash."""
    o = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    nation = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    payload = F.struct(F.col("c_custkey").alias("id"), nation.alias("nation"), F.col("c_name").alias("name"))
    return structs.flattened(o.select(F.col("o_orderkey").alias("id"), payload.alias("user"), F.col("o_orderstatus").alias("status")))


@query("SELECT o_orderkey, o_custkey, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate, o_orderkey")
def ordered_output(t):
    return tables.ordered(t("orders").select("o_orderkey", "o_custkey", "o_orderdate"), ["o_custkey", "o_orderdate", "o_orderkey"])
