"""Snapshots of the catalog's tables, and the versions of their schema."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import at
from ..schemas import TABLES, CatalogError

# The versions of the schema, in order.
MIGRATIONS = [(1, "initial"), (2, "add_topic_search_review"), (3, "add_topic_search_result_acceptance"), (4, "add_topic_search_run_stage")]

#: Seconds after which a claimed number that no publication has is taken for a lost writer's.
ABANDONED = 600.0


def empty_tables(spark: SparkSession) -> dict[str, DataFrame]:
    return {n: spark.createDataFrame([], s) for n, s in TABLES.items()}


def pending(files: DataFrame, applied: DataFrame) -> DataFrame:
    """Versions not yet applied, by version."""
    return files.join(applied.select("version").distinct(), "version", "left_anti").orderBy("version")


def migrate(applied: DataFrame, now: datetime) -> DataFrame:
    """applied (version, name, applied_at) with what was pending."""
    files = applied.sparkSession.createDataFrame(MIGRATIONS, "version int, name string")
    return applied.unionByName(pending(files, applied).withColumn("applied_at", at(now)))


def save(tables: dict[str, DataFrame], path: str, version: int | None = None, label: str = "") -> str:
    """Write a whole new snapshot, called by its version or label, with a manifest of its tables' rows and
    digests. Readers don't see it until `publish` points to it, so all tables of a change appear at once
    or not at all."""
    root, sums = f"{path.rstrip('/')}/{label or f'v{version:08d}'}", []
    for name, df in tables.items():
        df.write.mode("errorifexists").parquet(f"{root}/{name}.parquet")
        sums.append((name, *map(str, checksum(df.sparkSession.read.schema(df.schema).parquet(f"{root}/{name}.parquet")))))
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame(sums, "name string, n string, digest string").coalesce(1).write.mode("errorifexists").parquet(f"{root}/manifest.parquet")
    return root


def verify(spark: SparkSession, root: str) -> list[str]:
    """The tables of a snapshot that aren't as its manifest says; empty if it is sound."""
    try:
        told = spark.read.parquet(f"{root}/manifest.parquet").collect()  # a row a table
    except AnalysisException:
        return ["manifest"]
    wrong = []
    for row in told:
        try:
            sound = tuple(map(str, checksum(spark.read.parquet(f"{root}/{row['name']}.parquet")))) == (row["n"], row["digest"])
        except AnalysisException:
            sound = False
        if not sound:
            wrong.append(row["name"])
    return wrong


def _files(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


class Outdated(CatalogError):
    """Another writer published since the state was read."""


def pointer(spark: SparkSession, path: str) -> int:
    """The number of the last publication, 0 before the first."""
    files, at = _files(spark, f"{path.rstrip('/')}/current")
    return max((int(s.getPath().getName().split("-")[0]) for s in files.listStatus(at)), default=0) if files.exists(at) else 0


def publish(spark: SparkSession, path: str, root: str, base: int | None = None) -> int:
    """Make root the current snapshot: pointers are numbered, and the greatest that exists counts, so a
    reader sees the old one or the new one. base: the pointer when the state was read that root was made
    from; if it is no longer the last, Outdated is raised and nothing is changed. Returns the new pointer."""
    files, at = _files(spark, f"{path.rstrip('/')}/current")
    files.mkdirs(at)
    last = pointer(spark, path) if base is None else base
    if base is not None and pointer(spark, path) != base:
        raise Outdated(f"publication {base} is no longer the last")
    # the pointer's name has the root in it, so its number alone is claimed first, and by one writer
    number = last + 1
    while not _claimed(spark, f"{path.rstrip('/')}/claims/{number:08d}"):
        number += 1  # of a writer that was lost between its claim and its pointer
    _, name = _files(spark, f"{path.rstrip('/')}/current/{number:08d}-{root.rstrip('/').rsplit('/', 1)[1]}")
    files.createNewFile(name)
    if pointer(spark, path) != number:
        raise Outdated("another writer took this one for lost")
    return number


def _claimed(spark: SparkSession, path: str) -> bool:
    """Claim a number. False if its claim is old and was never used; a fresh one raises Outdated."""
    files, claim = _files(spark, path)
    try:
        if files.createNewFile(claim):
            return True
    except Py4JJavaError as e:  # the file came into being between look and create
        if "Exist" not in str(e.java_exception):
            raise
    if time.time() - files.getFileStatus(claim).getModificationTime() / 1000 < ABANDONED:
        raise Outdated("another writer published at the same time")
    return False


def commit(spark: SparkSession, path: str, change: Callable[[dict[str, DataFrame]], dict[str, DataFrame]], attempts: int = 5) -> str:
    """Apply change to the current tables and publish what it returns. Where another writer published
    meanwhile, change is replayed on that writer's tables, so no update is lost: change must be a pure
    function of the tables. Returns the new snapshot."""
    for _ in range(attempts):
        base, root = pointer(spark, path), current(spark, path)
        tables = load(spark, root) if root else empty_tables(spark)
        made = save(change(tables), path, label=f"v{base + 1:08d}-{uuid.uuid4().hex}")
        try:
            publish(spark, path, made, base)
            return made
        except Outdated:
            files, at = _files(spark, made)
            files.delete(at, True)
    raise Outdated(f"{attempts} attempts met other writers")


def current(spark: SparkSession, path: str) -> str | None:
    """The current snapshot, or None if none was published."""
    files, at = _files(spark, f"{path.rstrip('/')}/current")
    names = sorted(s.getPath().getName() for s in files.listStatus(at)) if files.exists(at) else []
    return f"{path.rstrip('/')}/{names[-1].split('-', 1)[1]}" if names else None


def restore(spark: SparkSession, backup: str, path: str, version: int) -> tuple[str, str | None]:
    """Make a copy of a sound backup the current snapshot below path; the one before stays where it is.
    Returns both."""
    if wrong := verify(spark, backup):
        raise CatalogError(f"the backup is damaged: {', '.join(wrong)}")
    before = current(spark, path)
    root = save(load(spark, backup), path, version)
    if wrong := verify(spark, root):
        raise CatalogError(f"the copy is damaged: {', '.join(wrong)}")
    publish(spark, path, root)
    return root, before


def load(spark: SparkSession, root: str, register: bool = False) -> dict[str, DataFrame]:
    """Tables of a snapshot; columns that an older one lacks are null."""
    out = {}
    for name, schema in TABLES.items():
        df = spark.read.parquet(f"{root}/{name}.parquet")
        want = spark.createDataFrame([], schema).schema
        out[name] = df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want])
        if register:
            out[name].createOrReplaceTempView(name)
    return out


def checksum(df: DataFrame) -> tuple[int, int]:
    """Rows, and a digest that no order of rows changes: to compare a backup with its source."""
    row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(F.to_json(F.struct(*df.columns))).cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def has_table(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)
