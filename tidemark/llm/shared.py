"""Tables in the folder that driver and executors share, and connected components by DataFrame operations."""

from __future__ import annotations

import atexit
import json
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Temporary folders of sessions on one machine, by application.
_OWN: dict[str, str] = {}
#: Keys whose rows may be dealt out over several tasks, at most, and the rows of a key from which that pays.
HOT, FREQUENT = 4096, 1000


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one, which only a session on one machine can use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        app = spark.sparkContext.applicationId
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="tidemark-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        found = _OWN[app]
    return found.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again, which cuts its lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{folder(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table of saved() that nothing needs any longer."""
    jvm = df.sparkSession.sparkContext._jvm
    for file in df.inputFiles()[:1]:
        path = jvm.org.apache.hadoop.fs.Path(file).getParent()
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(rows: DataFrame, found: DataFrame, keys: list[str], total: int, by: list[str]) -> DataFrame:
    """rows joined with `found`, which has one row for each key and the number `n` of its rows; frequent keys go to several tasks, dealt out by `by`.

    Of at most `total` rows, fewer than HOT keys have more than total / HOT, so what is broadcast has a bound at any size.
    """
    most = max(FREQUENT, total // HOT)
    if total <= most:
        return rows.join(found.drop("n"), keys)
    hot = F.broadcast(found.where(F.col("n") > most).select(*keys, F.ceil(F.col("n") / most).alias("_shares")))
    dealt = rows.join(hot, keys, "left").withColumn("_share", F.coalesce(F.pmod(F.xxhash64(*by), F.col("_shares")), F.lit(0).cast("long")))
    copies = found.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("n") / most) - 1))).drop("n")
    return dealt.drop("_shares").join(copies, [*keys, "_share"]).drop("_share")


#: Bits by which sifted() tells keys apart (half a megabyte), and those of a row of them, which Spark fixes.
SIEVE, BLOCK = 1 << 22, 1 << 15


def sifted(rows: DataFrame, keys: DataFrame, by: str) -> DataFrame:
    """rows with `_maybe`, which is false only where no row of keys has the value of `by` (an integer): what is false needs no join.

    The bits of the keys' hashes are broadcast, as many whatever the number of keys; with a million keys a fifth of the other rows may be among them.
    """
    place = F.pmod(F.xxhash64(F.col(by).cast("long")), F.lit(SIEVE))
    bit = place.bitwiseAND(BLOCK - 1)
    bits = keys.select(place.alias("_at")).groupBy(F.floor(F.col("_at") / BLOCK).alias("_block")).agg(F.bitmap_construct_agg(F.col("_at").bitwiseAND(BLOCK - 1)).alias("_bits"))
    found = rows.withColumn("_block", F.floor(place / BLOCK)).join(F.broadcast(bits), "_block", "left")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return found.withColumn("_maybe", F.coalesce(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1, F.lit(False))).select(*rows.columns, "_maybe")


#: Ranges that rows are dealt out to at most, rows looked at for each, and bounds that are compared at a time.
RANGES, LOOKS, STEP = 16_384, 20, 128


def ranges(df: DataFrame, by: list[str], count: int) -> Column:
    """The index, from 0, of the range of `by` (bigint columns, nulls first) that a row falls in: about `count` ranges of about as many rows.

    The bounds come from LOOKS sampled rows for each range, so what the driver gets has a bound.
    """
    count = min(count, RANGES)
    n = df.count() if count > 1 else 0
    if n < 2:
        return F.lit(0)
    seen = df.select(*(F.col(c).cast("long") for c in by)).sample(min(1.0, LOOKS * count / n), seed=7).collect()
    low = lambda row: [(v is not None, v or 0) for v in row]
    seen = sorted((tuple(r) for r in seen), key=low)
    step = max(1, len(seen) // count)
    bounds = sorted(set(seen[step::step]), key=low)
    if not bounds:
        return F.lit(0)
    kind = f"struct<{','.join(f'c{k}:bigint' for k in range(len(by)))}>"
    fixed = lambda rows, kind: F.from_json(F.lit(json.dumps(rows)), kind)
    named = [{f"c{k}": v for k, v in enumerate(b)} for b in bounds]
    groups = [named[k : k + STEP] for k in range(0, len(named), STEP)]
    key = F.struct(*(F.col(c).cast("long").alias(f"c{k}") for k, c in enumerate(by)))
    below = lambda array: F.size(F.filter(array, lambda b: b <= key))
    group = F.greatest(below(fixed([g[0] for g in groups], f"array<{kind}>")) - 1, F.lit(0))
    return group * STEP + below(F.get(fixed(groups, f"array<array<{kind}>>"), group))


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """(a, b, m): each edge with the smallest neighbour of a, a itself included."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
    return spread(edges, least, ["a"], total, ["b"])


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node that is reachable, for each node of `edges` (a, b).

    Alternates two steps until nothing changes: each node links its larger neighbours to its smallest one, then its
    smaller neighbours and itself. Stars of any size stay one row for each leaf, minima are combined before
    they are shuffled, and the rows of a hub are dealt out over tasks.
    """
    e = edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = saved(e, "edges")
    before = _state(e)
    for _ in range(rounds):
        total = 2 * before[0]
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, total).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = _with_least(large, total).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x"))
        new = saved(small.select("x.a", "x.b").where("a != b").distinct(), "edges")
        state = _state(new)
        dropped(e)
        e = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components didn't settle")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionAll(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
