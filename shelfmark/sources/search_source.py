"""The search service as a data source: a table of queries is read, its results come out.

    spark.dataSource.register(SearchSource)
    spark.read.format("catalog_search").option("endpoint", url).option("token", key).load(queries)

queries is a Parquet file or folder with the columns query and, if there is one, topic. Planning reads
only the files' footers; a partition is a batch of queries, and the task that reads it asks for them,
some at once. A query that fails makes one row with its error and no position, so it neither fails the
others nor goes unseen; one without results makes a row with neither.

The files are read by Arrow, so their path must be one that Arrow opens on the driver and the executors.
Requests cost money and answers change: write what is read before it is used twice, as `search_all` does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..numbering import shared_path
from ..schemas import BLOCKED_DOMAINS
from .edges import SEARCH_FIELDS
from .remote import Caller, Reply, side_by_side
from .services import read_answer

ROWS = "topic string, query string, position int, title string, url string, snippet string, provider_score double, attempts int, error string"


def request_body(query: str, max_results: int) -> bytes:
    fields = {"query": query, **SEARCH_FIELDS, "max_results": max_results if max_results > 0 else 10, "exclude_domains": BLOCKED_DOMAINS}
    return json.dumps(fields).encode()


def results_of(reply: Reply) -> tuple[list[tuple], str]:
    """(title, url, snippet, provider_score) of each result, and what went wrong, if anything."""
    if reply.error:
        return [], reply.error
    answer, error = read_answer("search", reply.status, reply.text)
    if error:
        return [], error
    text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x)
    number = lambda x: float(x) if isinstance(x, int | float) and not isinstance(x, bool) else None
    found = answer.get("results")
    rows = [r if isinstance(r, dict) else {} for r in found] if isinstance(found, list) else []
    return [(text(r.get("title")), text(r.get("url")), text(r.get("content")), number(r.get("score"))) for r in rows], ""


@dataclass
class Batch(InputPartition):
    """Rows start to stop of one row group of a file."""

    file: str
    group: int
    start: int
    stop: int


class SearchReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        if not (options.get("token") or "").strip():
            raise ValueError("the search service needs a token")
        self.path = options.get("path") or options["queries"]
        self.caller = Caller(options["endpoint"], options["token"], float(options.get("timeout", 15)), int(options.get("attempts", 3)), float(options.get("wait", 0.5)))
        self.most, self.size, self.width = int(options.get("max_results", 10)), max(1, int(options.get("batch", 100))), int(options.get("in_flight", 4))

    def partitions(self) -> list[Batch]:
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        store, at = pafs.FileSystem.from_uri(self.path)
        own = store.get_file_info(at)
        files = [own] if own.is_file else store.get_file_info(pafs.FileSelector(at, recursive=True))
        out = []
        for f in sorted(f.path for f in files if f.is_file and f.path.endswith(".parquet")):
            meta = pq.read_metadata(f, filesystem=store)
            for g in range(meta.num_row_groups):
                n = meta.row_group(g).num_rows
                out += [Batch(f, g, a, min(n, a + self.size)) for a in range(0, n, self.size)]
        return out

    def read(self, partition: Batch | None) -> Iterator[tuple]:
        if partition is None:  # no file had a row
            return
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        store, _ = pafs.FileSystem.from_uri(self.path)
        with store.open_input_file(partition.file) as f:
            file = pq.ParquetFile(f)
            columns = [c for c in ("topic", "query") if c in file.schema_arrow.names]
            rows = file.read_row_group(partition.group, columns).slice(partition.start, partition.stop - partition.start).to_pylist()
        for row, reply in side_by_side(lambda r: self.caller.ask(request_body(r["query"] or "", self.most)), rows, self.width):
            found, error = results_of(reply)
            key = (row.get("topic"), row["query"])
            for i, r in enumerate(found):
                yield (*key, i, *r, reply.attempts, "")
            if not found:
                yield (*key, None, None, None, None, None, reply.attempts, error)


class SearchSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "catalog_search"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> SearchReader:
        return SearchReader(dict(self.options))


def found_results(rows: DataFrame) -> DataFrame:
    """The rows of a search that are results, as candidates."""
    return rows.filter("position is not null").select("topic", "position", "title", "url", "snippet", "provider_score")


def failed_queries(rows: DataFrame) -> DataFrame:
    return rows.filter("error <> ''").select("topic", "query", "attempts", "error")


@dataclass(frozen=True)
class SearchAll:
    """A provider for many topics at once."""

    spark: SparkSession
    endpoint: str
    token: str
    timeout: float = 15.0
    attempts: int = 3
    wait: float = 0.5
    batch: int = 100
    in_flight: int = 4

    def search_all(self, queries: DataFrame, max_results: int = 10) -> DataFrame:
        """ROWS for queries (topic, query). Each is asked once: what is returned is read from the shared folder."""
        self.spark.dataSource.register(SearchSource)
        asked, answered = shared_path(queries, "queries"), shared_path(queries, "results")
        queries.select("topic", "query").write.parquet(asked)
        options = {"endpoint": self.endpoint, "token": self.token, "timeout": self.timeout, "attempts": self.attempts, "wait": self.wait, "batch": self.batch, "in_flight": self.in_flight, "max_results": max_results}
        self.spark.read.format("catalog_search").options(**options).load(asked).write.parquet(answered)
        return self.spark.read.schema(ROWS).parquet(answered)


def with_topics(rows: DataFrame) -> DataFrame:
    """rows of one query each, counted: topic, n_results, error."""
    return rows.groupBy("topic").agg(F.count("position").alias("n_results"), F.max("error").alias("error"))
