"""Reading and writing tables and files."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table `name` of a folder; filters and columns reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, columns: Sequence[str] = ("*",), skip_bad: bool = True) -> DataFrame:
    """The columns of CSV files with a header; rows that don't fit the schema are left out, or fail the read."""
    mode = "DROPMALFORMED" if skip_bad else "FAILFAST"
    return spark.read.schema(schema).options(header=True, mode=mode).csv(path).select(*columns)


def typed_json(df: DataFrame, column: str, schema: str, out: str) -> DataFrame:
    """df with the JSON text of a column as a struct, null where it can't be read."""
    return df.withColumn(out, F.from_json(column, schema))


def json_map(text, path: str):
    """The object at a path as a map with integer keys, as in {"1": 5, "2": 0}."""
    found = F.from_json(F.get_json_object(text, path), "map<string,int>")
    return F.transform_keys(found, lambda k, _: k.cast("int"))


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def overwrite(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def ordered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """df in a total order, nulls last: ranges of rows are sorted one beside the other."""
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in columns))


def write_sorted(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    """Writes df in ranges of the columns, each file sorted, so that filters on them skip files and row groups."""
    df.repartitionByRange(*columns).sortWithinPartitions(*columns).write.mode("overwrite").parquet(path)


def save_table(df: DataFrame, name: str) -> None:
    df.write.mode("overwrite").saveAsTable(name)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def discard(df: DataFrame) -> None:
    """Runs df to its end and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


RAW_SCHEMA = "raw_id string, raw_json string, scraped_at string, scraper_version string"


def empty(spark: SparkSession, schema: str = RAW_SCHEMA) -> DataFrame:
    return spark.createDataFrame([], schema)


def missing(wanted: DataFrame, have: DataFrame, key: str, have_key: str) -> DataFrame:
    """The rows of wanted whose key isn't there yet: what a resumed ingestion has left to do."""
    return wanted.join(have.select(F.col(have_key).alias(key)), key, "left_anti")


def updated(df: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """df with the columns taken from the row of changes with the same key, where there is one and its value isn't null."""
    new = changes.select(key, *(F.col(c).alias(f"_new_{c}") for c in columns))
    return df.join(new, key, "left").withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop(*(f"_new_{c}" for c in columns))


def kept_in(df: DataFrame, sample: DataFrame, key: str) -> DataFrame:
    """The rows of df whose key is in the sample."""
    return df.join(sample.select(key), key, "left_semi")


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written in the folder that spark.checkpoint.dir names and read again, for what several branches of a plan read; df itself where none is set."""
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
    if not folder:
        return df
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task gets on average where rows are dealt out by a key.
DEALT = 100_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt out by keys to as many tasks as `rows`, about the number of its rows, ask for: what a task holds doesn't grow with the table."""
    return df.repartition(max(1, -(-rows // DEALT)), *keys)


def save_bucketed(df: DataFrame, table: str, keys: Sequence[str], order: Sequence[str], buckets: int) -> None:
    """df as a table of one file for each bucket of `keys`, sorted by keys and order: histories, as-of joins and joins by these keys then read it without a shuffle."""
    df.repartition(buckets, *keys).sortWithinPartitions(*keys, *order).write.bucketBy(buckets, *keys).sortBy(*keys, *order).mode("overwrite").saveAsTable(table)
