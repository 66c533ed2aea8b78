import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.streaming import roles


@pytest.fixture(autouse=True)
def state_on_disk(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, roles.ROCKSDB)
    yield
    spark.conf.set(name, before)


def ended(q):
    q.awaitTermination(120)
    assert q.exception() is None


class Feed:
    """A folder that a stream reads file by file, and a run that goes on from one checkpoint."""

    def __init__(self, spark, folder, schema):
        self.spark, self.folder, self.schema, self.count = spark, folder, schema, 0

    def add(self, *rows):
        self.spark.createDataFrame(list(rows), self.schema).coalesce(1).write.parquet(f"{self.folder}/in/{self.count:03}")
        self.count += 1

    def stream(self):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{self.folder}/in")

    def totals(self, **kw):
        """The rows of one run, which starts again from the checkpoint."""
        out = f"{self.folder}/out{self.count}"
        write = lambda df, k: df.write.mode("overwrite").parquet(f"{out}/batch={k}")
        ended(roles.running_totals(self.stream(), "u", "kind", "value", **kw).writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{self.folder}/check").trigger(availableNow=True).start())
        return sorted((r.u, r.events, r.kinds, r.total, r.done) for r in self.spark.read.parquet(out).drop("batch").collect())


def at(minute):
    return datetime.datetime(2024, 1, 1, 0, 0) + datetime.timedelta(minutes=minute)


SCHEMA = "u long, kind string, value double, ts timestamp"


def test_totals_go_on_after_a_restart(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), SCHEMA)
    feed.add((1, "a", 2.0, at(0)), (1, "b", None, at(1)), (2, None, 1.0, at(2)))
    assert feed.totals() == [(1, 2, 2, 2.0, False), (2, 1, 0, 1.0, False)]
    feed.add((1, "a", 3.0, at(3)), (1, "c", 0.5, None))
    assert feed.totals() == [(1, 4, 3, 5.5, False)]


def test_late_rows_and_keys_that_went_quiet(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), SCHEMA)
    kw = {"time": "ts", "late": "10 minutes", "idle_seconds": 1800}
    feed.add((1, "a", 1.0, at(0)), (2, "a", 1.0, at(0)))
    feed.add((2, "b", 1.0, at(30)))
    assert {(1, 1, 1, 1.0, False), (2, 2, 2, 2.0, False)} <= set(feed.totals(**kw))
    feed.add((2, "a", 4.0, at(5)), (2, "a", 1.0, at(25)))  # the watermark is at 20: the first is too late
    assert feed.totals(**kw) == [(2, 3, 2, 3.0, False)]
    feed.add((3, "a", 1.0, at(55)))  # the watermark goes to 45: key 1 has been quiet for 45 minutes, key 2 for 15
    got = feed.totals(**kw)
    assert (1, 1, 1, 1.0, True) in got and (3, 1, 1, 1.0, False) in got and not any(u == 2 for u, *_ in got)
    feed.add((1, "z", 7.0, at(56)))  # starts anew
    assert (1, 1, 1, 7.0, False) in feed.totals(**kw)


def test_rows_are_appended_once(spark, tmp_path):
    feed = Feed(spark, str(tmp_path), "id long, ts timestamp")

    def run(check="c"):
        ended(roles.append_new(feed.stream(), f"{tmp_path}/t", "id", "ts", "1 hour", f"{tmp_path}/{check}"))
        return sorted(r.id for r in spark.read.parquet(f"{tmp_path}/t").collect())

    feed.add((1, at(0)), (1, at(1)), (2, at(0)))
    assert run() == [1, 2]
    feed.add((2, at(20)), (3, at(200)))
    assert run() == [1, 2, 3] and run() == [1, 2, 3]
    feed.add((4, at(5)), (5, at(190)), (3, at(201)))  # 4 is later than the hour
    assert run() == [1, 2, 3, 5]
    # a batch whose folder was written but not committed runs again and replaces it
    import pathlib

    last = max((tmp_path / "c" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for f in (last, last.with_name(f".{last.name}.crc")):
        pathlib.Path(f).unlink(missing_ok=True)
    assert run() == [1, 2, 3, 5]


def test_streams_of_events(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    q = roles.running_totals(stream(), "user_id", "event_type", "value").writeStream.format("memory").queryName("totals").outputMode("update").trigger(availableNow=True).start()
    ended(q)
    last = spark.table("totals").groupBy("user_id").agg(F.max_by(F.struct("events", "kinds", F.round("total", 3).alias("total")), "events").alias("x")).select("user_id", "x.*")
    want = events.groupBy("user_id").agg(F.count("*"), F.countDistinct("event_type"), F.round(F.sum("value"), 3))
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, want.collect()))

    q = roles.windowed_counts(stream(), "ts", ["event_type"], "1 day", "60 days").writeStream.format("memory").queryName("days").outputMode("complete").trigger(availableNow=True).start()
    ended(q)
    assert spark.table("days").agg(F.sum("n")).first()[0] == events.count()

    for _ in range(2):
        ended(roles.append_new(stream(), str(tmp_path / "out"), "event_id", "ts", "3650 days", str(tmp_path / "check")))
    assert spark.read.parquet(str(tmp_path / "out")).count() == events.count()
