import json

import pytest
from pyspark.sql import functions as F

from tidemark.sources import http, tables


def test_csv_with_bad_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,x\nbad,y\n3,\n")
    got = tables.read_csv(spark, str(tmp_path / "*.csv"), "id long, name string", ["name", "id"])
    assert sorted((r.id, r.name) for r in got.collect()) == [(1, "x"), (3, None)]
    with pytest.raises(Exception, match="MALFORMED|malformed|FAILFAST"):
        tables.read_csv(spark, str(tmp_path / "*.csv"), "id long, name string", skip_bad=False).collect()


def test_json(spark):
    df = spark.createDataFrame([('{"week_of_year": {"1": 5, "53": 2}}',), ("broken",)], "j string")
    got = [r.m for r in df.select(tables.json_map("j", "$.week_of_year").alias("m")).collect()]
    assert got == [{1: 5, 53: 2}, None]
    assert tables.typed_json(df, "j", "week_of_year map<string,int>", "x").where("x.week_of_year IS NULL").count() == 1


def test_sinks_and_changes(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    path = str(tmp_path / "t")
    tables.overwrite(df, path)
    tables.append(df.limit(1), path)
    assert spark.read.parquet(path).count() == 3
    tables.write_json(df, str(tmp_path / "j"))
    tables.discard(df)
    changed = tables.updated(df, spark.createDataFrame([(2, "c"), (1, None), (9, "z")], "k long, v string"), "k", ["v"])
    assert sorted(tuple(r) for r in changed.collect()) == [(1, "a"), (2, "c")]
    assert tables.missing(df, df.where("k = 1"), "k", "k").first().k == 2
    assert tables.kept_in(df, df.where("k = 1"), "k").first().k == 1
    assert tables.empty(spark).count() == 0


def client(answers, **kw):
    calls, slept = [], []

    def fetch(params):
        calls.append(params)
        return answers(params)

    now = [0.0]

    def sleep(s):
        slept.append(s)
        now[0] += s

    return http.Client(fetch, sleep=sleep, clock=lambda: now[0], **kw), calls, slept


def test_pages_until_all_are_there():
    data = [{"id": k} for k in range(450)]
    c, calls, slept = client(lambda p: (200, {}, {"results": data[(p["page"] - 1) * p["per_page"] : p["page"] * p["per_page"]], "total_results": 450}), per_minute=60)
    assert list(c.pages({})) == data and len(calls) == 3 and slept == [1.0, 1.0]


def test_retry_waits_as_told_and_gives_up():
    answers = iter([(429, {"Retry-After": "9"}, {}), (503, {}, {}), (200, {}, {"results": [1], "total_results": 1})])
    c, calls, slept = client(lambda p: next(answers), per_minute=6000)
    assert list(c.pages({})) == [1] and len(calls) == 3 and 9 <= slept[0] <= 10 and 4 <= slept[-1] <= 5
    with pytest.raises(OSError):
        client(lambda p: (503, {}, {}), tries=2)[0].call({})
    with pytest.raises(OSError):
        client(lambda p: (404, {}, {}))[0].call({})
    assert client(lambda p: (500, {}, {}), empty_on_500=True)[0].call({})["results"] == []


def web(folder, rows=(), broken=()):
    """A fetch function for tasks: every call leaves a file; each parameter of `broken` fails with 429 at its first call."""

    def fetch(params):
        import os
        import time
        import uuid

        key = str(params.get("id", params.get("taxon", params.get("page"))))
        seen = any(f.startswith("busy-" + key) for f in os.listdir(folder))
        busy = key in broken and not seen
        with open(f"{folder}/{'busy' if busy else 'call'}-{key.split(',')[0]}-{uuid.uuid4().hex}", "w") as f:
            f.write(f"{os.getpid()} {time.time()}")
        if busy:
            return 429, {"Retry-After": "0"}, {}
        if "id" in params:
            got = [{"id": int(k), "v": "x" * (int(k) % 3)} for k in params["id"].split(",")]
        elif "taxon" in params:
            got = [] if params["taxon"] == "x" else [{"of": params["taxon"]}]
        else:
            n = int(open(f"{rows}").read())
            a = (params["page"] - 1) * params["per_page"]
            return 200, {}, {"results": [{"id": k, "q": params.get("q")} for k in range(a, min(n, a + params["per_page"]))], "total_results": n}
        return 200, {}, {"results": got[: params["per_page"]], "total_results": len(got)}

    return fetch


def test_ids_are_fetched_in_lanes_and_resumed(spark, tmp_path):
    (tmp_path / "log").mkdir()
    calls = http.Calls(http.Client(web(str(tmp_path / "log"), broken=("5",)), per_minute=60000, first_wait=0.01), "2024-01-01", "1", chunk=1, lanes=4)
    ids = spark.range(40).withColumn("id", F.when(F.col("id") < 38, F.col("id")))
    got = http.land(ids.where("id < 10").unionAll(ids.where("id < 3")), "id", str(tmp_path / "raw"), calls)
    assert sorted(int(r.raw_id) for r in got.collect()) == list(range(10))
    assert len(list((tmp_path / "log").glob("call-*"))) == 10 and len(list((tmp_path / "log").glob("busy-5-*"))) == 1
    got = http.land(ids, "id", str(tmp_path / "raw"), calls, rounds=3).collect()
    assert sorted(int(r.raw_id) for r in got) == list(range(38)) and {r.scraped_at for r in got} == {"2024-01-01"}
    assert len(list((tmp_path / "log").glob("call-*"))) == 38  # nothing was asked for twice
    assert http.fetched(ids, "id", calls).rdd.getNumPartitions() == 4
    assert http.land(ids.limit(0), "id", str(tmp_path / "none"), calls).count() == 0


def test_chunks_placeholders_and_failures(spark, tmp_path):
    (tmp_path / "log").mkdir()
    client = http.Client(web(str(tmp_path / "log")), per_minute=60000)
    got = http.fetched(spark.range(450).repartition(7), "id", http.Calls(client, "d", "1", chunk=100, lanes=3)).collect()
    assert sorted(int(r.raw_id) for r in got) == list(range(450)) and len(list((tmp_path / "log").glob("call-*"))) <= 4 + 3
    taxa = spark.createDataFrame([("a",), ("x",), (None,)], "taxon string")
    single = http.Calls(client, "d", "1", param="taxon", chunk=None, placeholder=True, lanes=2)
    assert sorted((r.raw_id, r.raw_json) for r in http.fetched(taxa, "taxon", single).collect()) == [("a", '{"of": "a"}'), ("x", None)]
    with pytest.raises(Exception, match="status 404"):
        http.fetched(taxa, "taxon", http.Calls(http.Client(lambda p: (404, {}, {})), "d", "1", param="taxon", chunk=None)).collect()


def test_lanes_share_the_rate(spark, tmp_path):
    (tmp_path / "log").mkdir()
    calls = http.Calls(http.Client(web(str(tmp_path / "log")), per_minute=1200), "d", "1", chunk=1, lanes=4)
    http.fetched(spark.range(24), "id", calls).collect()
    times = sorted(float(f.read_text().split()[1]) for f in (tmp_path / "log").glob("call-*"))
    assert len(times) == 24
    for a in times:  # 4 calls at once, then at most 20 a second
        assert sum(a <= b < a + 0.39 for b in times) <= 4 * 2


def test_a_listing_as_batch_and_as_stream(spark, tmp_path):
    (tmp_path / "log").mkdir()
    (tmp_path / "rows").write_text("95")
    client = http.Client(web(str(tmp_path / "log"), tmp_path / "rows", broken=("3",)), per_minute=60000, first_wait=0.01)
    http.register_listing(spark, "listing_of_tests", http.Calls(client, "d", "1", lanes=4), per_page=10)
    df = spark.read.format("listing_of_tests").option("q", "z").load()
    assert df.rdd.getNumPartitions() == 4
    got = df.collect()
    assert sorted(int(r.raw_id) for r in got) == list(range(95)) and {json.loads(r.raw_json)["q"] for r in got} == {"z"}

    def run():
        stream = spark.readStream.format("listing_of_tests").load()
        q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination(90)
        assert q.exception() is None
        return sorted(int(r.raw_id) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == list(range(95))
    (tmp_path / "rows").write_text("123")
    before = len(list((tmp_path / "log").glob("call-*")))
    assert run() == list(range(123))
    assert len(list((tmp_path / "log").glob("call-*"))) - before <= 4 + 3  # the pages of rows 95 to 122, and the size
    (tmp_path / "rows").write_text("0")
    assert spark.read.format("listing_of_tests").load().count() == 0


def test_a_bucketed_table_needs_no_shuffle(spark, sf):
    from tidemark.operators import windows as W

    orders = spark.read.parquet(f"{sf}/orders.parquet")
    tables.save_bucketed(orders, "orders_by_customer", ["o_custkey"], ["o_orderdate", "o_orderkey"], 4)
    tables.save_bucketed(spark.read.parquet(f"{sf}/customer.parquet").withColumnRenamed("c_custkey", "o_custkey"), "customers", ["o_custkey"], [], 4)
    read = spark.table("orders_by_customer")
    history = read.withColumn("n", F.count(F.lit(1)).over(W.before(["o_custkey"], ["o_orderdate", "o_orderkey"])))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(history)
    joined = history.hint("merge").join(spark.table("customers"), "o_custkey")
    assert "Exchange" not in plan(joined) and joined.count() == orders.count()
    by = orders.withColumn("n", F.count(F.lit(1)).over(W.before(["o_custkey"], ["o_orderdate", "o_orderkey"])))
    assert {(r.o_orderkey, r.n) for r in history.collect()} == {(r.o_orderkey, r.n) for r in by.collect()}
    tables.save_bucketed(orders.limit(10), "orders_by_customer", ["o_custkey"], ["o_orderdate"], 2)
    assert spark.table("orders_by_customer").count() == 10
    for name in ("orders_by_customer", "customers"):
        spark.sql(f"DROP TABLE {name}")
