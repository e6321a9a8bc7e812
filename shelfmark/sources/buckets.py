"""Snapshots in parts: each table is cut by a hash of the topic it belongs to, and a version is a list of
which part lies where. A change rewrites only the parts that its topics are in and points to the old
version's files for the others; a reader who wants some topics opens only their parts.

Versions are published as whole snapshots are, by `store.publish`, so all parts of a change appear at
once. Old versions can be deleted only as far as no newer list points to their files (`live_roots`)."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TABLES
from . import store

#: What a table is cut by: topics by their slug, imports by the slug they name, all else by its topic.
CUT_BY = {"topics": "slug", "imports": "topic"}
PARTS = "name string, part int, root string, n long, top long"


def part_of(table: str, n_parts: int) -> Column:
    key = F.col(CUT_BY.get(table, "topic_id")).cast("string")
    return F.pmod(F.xxhash64(F.coalesce(key, F.lit(""))), F.lit(n_parts)).cast("int")


@dataclass(frozen=True)
class Parts:
    """A version: where each part lies, its rows, and the greatest id of it. A row a part."""

    root: str
    n_parts: int
    rows: tuple[tuple[str, int, str, int, int], ...]

    def top(self, table: str) -> int:
        """The greatest id of a table: new rows go above it, whichever parts are at hand."""
        return max((t for name, _, _, _, t in self.rows if name == table), default=0)


def open_parts(spark: SparkSession, root: str) -> Parts:
    rows = [tuple(r) for r in spark.read.schema(PARTS + ", n_parts int").parquet(f"{root}/parts.parquet").collect()]  # a row a part
    return Parts(root, rows[0][5] if rows else 1, tuple(r[:5] for r in rows))


def _write(spark: SparkSession, tables: dict[str, DataFrame], path: str, n_parts: int, kept: list[tuple]) -> Parts:
    root, rows = f"{path.rstrip('/')}/p{uuid.uuid4().hex}", list(kept)
    for name, df in tables.items():
        cut = df.withColumn("_part", part_of(name, n_parts))
        cut.repartition("_part").write.partitionBy("_part").parquet(f"{root}/{name}")
        back = spark.read.schema(T.StructType([*df.schema, T.StructField("_part", T.IntegerType())])).parquet(f"{root}/{name}")
        rows += [(name, r["_part"], root, r["n"], r["top"]) for r in back.groupBy("_part").agg(F.count("*").alias("n"), F.coalesce(F.max("id"), F.lit(0)).cast("long").alias("top")).collect()]  # a row a part
    listed = [(*r, n_parts) for r in sorted(rows)]
    spark.createDataFrame(listed, PARTS + ", n_parts int").coalesce(1).write.parquet(f"{root}/parts.parquet")
    return Parts(root, n_parts, tuple(sorted(rows)))


def save_parts(tables: dict[str, DataFrame], path: str, n_parts: int = 64) -> Parts:
    """A first version of whole tables."""
    return _write(next(iter(tables.values())).sparkSession, tables, path, n_parts, [])


def read_parts(spark: SparkSession, parts: Parts, table: str, only: set[int] | None = None) -> DataFrame:
    """A table, or those of its parts that are in only."""
    schema = spark.createDataFrame([], TABLES[table]).schema
    paths = [f"{root}/{table}/_part={part}" for name, part, root, n, _ in parts.rows if name == table and n and (only is None or part in only)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def parts_of(keys: DataFrame, table: str, n_parts: int) -> set[int]:
    """The parts of a table that keys (with the column that it is cut by) fall into: n_parts at most."""
    return {r["p"] for r in keys.select(part_of(table, n_parts).alias("p")).distinct().collect()}


def change_parts(spark: SparkSession, path: str, parts: Parts, touched: dict[str, DataFrame], change: Callable[[dict[str, DataFrame], dict[str, int]], dict[str, DataFrame]]) -> Parts:
    """A new version. touched: of each table that changes, the keys whose parts may. change gets these
    parts' rows, and the greatest id of each whole table, and returns the rows as they are to be; it may
    move no row to another part."""
    hit = {t: parts_of(keys, t, parts.n_parts) for t, keys in touched.items()}
    now = {t: read_parts(spark, parts, t, p) for t, p in hit.items()}
    after = change(now, {t: parts.top(t) for t in now})
    kept = [r for r in parts.rows if r[1] not in hit.get(r[0], set())]
    made = _write(spark, after, path, parts.n_parts, kept)
    for t, p in hit.items():
        strange = {r[1] for r in made.rows if r[0] == t and r[2] == made.root} - p
        if strange:
            raise store.CatalogError(f"{t}: rows in parts {sorted(strange)}, which weren't read")
    return made


def commit_parts(spark: SparkSession, path: str, touched: dict[str, DataFrame], change: Callable[[dict[str, DataFrame], dict[str, int]], dict[str, DataFrame]], attempts: int = 5) -> Parts:
    """change_parts of the current version, published; replayed on a newer one if another writer was first."""
    for _ in range(attempts):
        base, root = store.pointer(spark, path), store.current(spark, path)
        made = change_parts(spark, path, open_parts(spark, root), touched, change)
        try:
            store.publish(spark, path, made.root, base)
            return made
        except store.Outdated:
            continue
    raise store.Outdated(f"{attempts} attempts met other writers")


def live_roots(versions: list[Parts]) -> set[str]:
    """The roots whose files the given versions still need."""
    return {r[2] for v in versions for r in v.rows} | {v.root for v in versions}
