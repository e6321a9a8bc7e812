"""Consecutive numbers in a given order, however many rows there are."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: The paths that each application made, so that they can be deleted.
_PATHS: dict[str, list[str]] = {}


def clear_shared(spark: SparkSession, *keep: str) -> None:
    """Delete what this application wrote below shared paths, but for those in keep; a result that still
    reads from there must be written before."""
    paths = _PATHS.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        if path not in keep:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _PATHS[spark.sparkContext.applicationId] = list(keep)


def shared_path(df: DataFrame, name: str) -> str:
    """A fresh path below spark.checkpoint.dir; where that is unset, a local master's temporary folder."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """df from the shared folder: computed once, however often it is read."""
    path = shared_path(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def number_rows(rows: DataFrame, order: list[Column | str], name: str, first: Column | None = None) -> DataFrame:
    """rows with `name`: first (1), first + 1 and so on in the order, which ascends and must be total.

    Rows are dealt by range and written; a row's number is the count in the partitions before its own,
    of which there are as many as shuffle partitions, plus its place in its own."""
    spark = rows.sparkSession
    keys = [f"_key{i}" for i in range(len(order))]
    keyed = rows.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(k) for c, k in zip(order, keys, strict=True)])
    path = shared_path(rows, "numbered")
    keyed.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema(keyed.withColumn("_part", F.lit(0)).schema).parquet(path)
    before, total = [], 0
    for part, n in sorted(dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # a row a partition
        before.append((part, total))
        total += n
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    offsets = spark.createDataFrame(before, "_part int, _before long")
    number = (F.lit(1) if first is None else first) - 1 + F.col("_before") + own
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, number.cast("long")).drop("_part", "_before", *keys)


def number_in_groups(rows: DataFrame, group: str, order: list[Column | str], name: str) -> DataFrame:
    """As number_rows in the order of group and then `order`, where rows have few groups and a task can sort
    one of them: rows are dealt once, by group, and nothing is written. A group's number is the count of the
    groups before it, one short row a group."""
    earlier = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(group).agg(F.count("*").alias("_size")).select(group, F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_own", own).join(F.broadcast(sizes), group).withColumn(name, (F.col("_before") + F.col("_own")).cast("long")).drop("_own", "_before")
