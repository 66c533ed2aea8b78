"""A paged, rate-limited web source whose calls run in tasks: by the ids of a DataFrame, or as a data source over the pages of a listing.

The work is cut in lanes. A lane is one task with its share of the rate, so that the calls of all executors together keep to it, however many
run at once (with speculation off). A task that is lost calls again for its lane. The driver gets no rows, and of a listing only its size.
"""

from __future__ import annotations

import copy
import json
import random
import time
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tidemark.sources.tables import RAW_SCHEMA, append, missing

Fetch = Callable[[dict], tuple[int, dict, dict]]  # parameters -> status, headers, payload


class Client:
    """Calls `fetch` at most `per_minute` times a minute and again after a status of 429 or 503."""

    def __init__(self, fetch: Fetch, per_minute: int = 60, tries: int = 5, first_wait: float = 2.0, longest_wait: float = 60.0, empty_on_500: bool = False, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.monotonic):
        self.fetch, self.gap, self.tries, self.first_wait, self.longest_wait = fetch, 60 / per_minute, tries, first_wait, longest_wait
        self.empty_on_500, self.sleep, self.clock, self.next = empty_on_500, sleep, clock, 0.0

    def of_lane(self, lanes: int) -> Client:
        """A client for one of so many tasks, with its share of the rate."""
        part = copy.copy(self)
        part.gap, part.next = self.gap * lanes, 0.0
        return part

    def call(self, params: dict) -> dict:
        wait = self.first_wait
        for left in range(self.tries, 0, -1):
            if (now := self.clock()) < self.next:
                self.sleep(self.next - now)
            self.next = max(self.clock(), self.next) + self.gap
            status, headers, payload = self.fetch(params)
            if status == 200:
                return payload
            if status == 500 and self.empty_on_500:
                return {"results": [], "total_results": 0}
            if status not in (429, 503) or left == 1:
                raise OSError(f"status {status}")
            self.sleep(min(self.longest_wait, float(headers.get("Retry-After", wait)) + random.random()))
            wait = min(self.longest_wait, wait * 2)
        raise OSError("no try left")

    def pages(self, params: dict, per_page: int = 200) -> Iterator[dict]:
        page = 1
        while True:
            got = self.call({**params, "page": page, "per_page": per_page})
            yield from got.get("results", [])
            if page * per_page >= got.get("total_results", 0):
                return
            page += 1

    def by_chunks(self, ids: Sequence[str], param: str, chunk: int = 200) -> Iterator[tuple[str, dict]]:
        """(first id of the chunk, result) of calls with comma-joined ids."""
        for k in range(0, len(ids), chunk):
            for row in self.pages({param: ",".join(map(str, ids[k : k + chunk]))}, chunk):
                yield ids[k], row

    def one_by_one(self, ids: Iterable[str], param: str, placeholder: bool = False) -> Iterator[tuple[str, dict | None]]:
        """(id, result) of one call for each id; with a placeholder also (id, None) for an id without results."""
        for i in ids:
            found = False
            for row in self.pages({param: i}):
                found = True
                yield i, row
            if placeholder and not found:
                yield i, None


def raw_id(row: dict, source: str | None = None) -> str | None:
    """The first of the row's uuid, its id and the id that it was asked for by."""
    return next((str(x) for x in (row.get("uuid"), row.get("id"), source) if x is not None), None)


@dataclass(frozen=True)
class Calls:
    """How to call and what to stamp rows with.

    chunk: ids of one call, comma-joined; None: a call for each id. placeholder: a row without JSON for an id that has no result (single ids only).
    """

    client: Client
    scraped_at: str
    version: str
    param: str = "id"
    chunk: int | None = 200
    placeholder: bool = False
    lanes: int = 8

    def row(self, source: str | None, found: dict | None) -> tuple:
        return raw_id(found or {}, source), None if found is None else json.dumps(found), self.scraped_at, self.version

    def rows(self, client: Client, ids: Sequence[str]) -> Iterator[tuple]:
        got = client.one_by_one(ids, self.param, self.placeholder) if self.chunk is None else client.by_chunks(ids, self.param, self.chunk)
        return (self.row(source, found) for source, found in got)


def fetched(ids: DataFrame, id: str, calls: Calls) -> DataFrame:
    """The raw rows of the ids, each id asked for once; null ids are left out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, names = calls.client.of_lane(calls.lanes), RAW_NAMES
        step = calls.chunk or 1
        held: list[str] = []
        for part in parts:
            held += part[id].to_list()
            whole = len(held) // step * step
            for k in range(0, whole, step):
                yield pd.DataFrame(calls.rows(client, held[k : k + step]), columns=names)
            held = held[whole:]
        if held:
            yield pd.DataFrame(calls.rows(client, held), columns=names)

    wanted = ids.select(F.col(id).cast("string").alias(id)).where(F.col(id).isNotNull()).distinct()
    return wanted.repartition(calls.lanes, id).mapInPandas(run, RAW_SCHEMA)


def land(ids: DataFrame, id: str, path: str, calls: Calls, rounds: int = 1) -> DataFrame:
    """Appends the rows of the ids that the raw table at path doesn't have, and returns the table.

    Each round of ids is a write of its own; a run that stopped goes on with what no ended round has landed. An id counts as landed
    if a row has it as raw_id: so have the rows of calls by the rows' own ids, and placeholders.
    """
    spark = ids.sparkSession
    append(spark.createDataFrame([], RAW_SCHEMA), path)
    for k in range(rounds):
        mine = ids.select(F.col(id).cast("string").alias(id)).where(F.pmod(F.xxhash64(F.col(id).cast("string")), F.lit(rounds)) == k)
        append(fetched(missing(mine, spark.read.schema(RAW_SCHEMA).parquet(path), id, "raw_id"), id, calls), path)
    return spark.read.schema(RAW_SCHEMA).parquet(path)


RAW_NAMES = [part.split()[0] for part in RAW_SCHEMA.split(", ")]


@dataclass
class Span(InputPartition):
    """Rows begin to end (exclusive) of a listing."""

    begin: int
    end: int


class Listing:
    """The pages of one set of parameters; new rows come at its end."""

    def __init__(self, calls: Calls, params: Mapping[str, str], per_page: int):
        self.calls, self.params, self.per_page = calls, dict(params), per_page

    def size(self) -> int:
        return int(self.calls.client.call({**self.params, "page": 1, "per_page": 1}).get("total_results", 0))

    def spans(self, begin: int, end: int) -> list[Span]:
        """At most a span for each lane, cut between pages; an empty one if there are no rows, as Spark reads at least one."""
        if begin >= end:
            return [Span(begin, begin)]
        first, last = begin // self.per_page, -(-end // self.per_page)
        cuts = [first + (last - first) * k // self.calls.lanes for k in range(self.calls.lanes + 1)]
        return [Span(max(begin, a * self.per_page), min(end, b * self.per_page)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if a < b]

    def read(self, span: Span) -> Iterator[tuple]:
        if span.begin == span.end:
            return
        client = self.calls.client.of_lane(self.calls.lanes)
        for page in range(span.begin // self.per_page, -(-span.end // self.per_page)):
            at = page * self.per_page
            got = client.call({**self.params, "page": page + 1, "per_page": self.per_page}).get("results", [])
            for found in got[max(0, span.begin - at) : span.end - at]:
                yield self.calls.row(None, found)


class ListingReader(DataSourceReader):
    def __init__(self, listing: Listing):
        self.listing = listing

    def partitions(self) -> Sequence[InputPartition]:
        return self.listing.spans(0, self.listing.size())

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.listing.read(partition)


class ListingStream(DataSourceStreamReader):
    """Offsets are numbers of rows; a batch reads the rows that came since the last one, and a restart goes on from the checkpoint."""

    def __init__(self, listing: Listing):
        self.listing = listing

    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        return {"rows": self.listing.size()}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return self.listing.spans(start["rows"], end["rows"])

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.listing.read(partition)

    def commit(self, end: dict) -> None:
        pass


def register_listing(spark: SparkSession, format: str, calls: Calls, per_page: int = 200) -> None:
    """Makes `spark.read.format(format)` and `spark.readStream.format(format)` read a listing; their options are its parameters."""

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return format

        def schema(self) -> str:
            return RAW_SCHEMA

        def reader(self, schema) -> DataSourceReader:
            return ListingReader(Listing(calls, self.options, per_page))

        def streamReader(self, schema) -> DataSourceStreamReader:
            return ListingStream(Listing(calls, self.options, per_page))

    spark.dataSource.register(Source)
