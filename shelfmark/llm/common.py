"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: ASCII blanks only: the same set as bytes.split() uses.
WORD = r"[^\x20\x09-\x0D]+"


#: The scratch paths of each application, so that they can be deleted.
_PATHS: dict[str, list[str]] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below spark.checkpoint.dir, which driver and executors share. Where it is unset, a
    temporary folder serves a local master, whose executors are the driver; a cluster is refused."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints"
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _PATHS.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def clear(spark: SparkSession, *keep: str) -> None:
    """Delete the application's scratch paths but for those in keep; results that still read them are lost."""
    jvm, paths = spark.sparkContext._jvm, _PATHS.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        if path not in keep:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _PATHS[spark.sparkContext.applicationId] = list(keep)


def discard(spark: SparkSession, path: str) -> None:
    """Delete one scratch path that nothing reads any more."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _PATHS[spark.sparkContext.applicationId].remove(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 400) -> None:
    """Bound the memory of an Arrow batch: texts may be very long. Spark reads these settings when the
    result is computed, so they stay set in the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType) -> DataFrame:
    """df.mapInArrow, but for columns of any name: that one can't find a column whose name has a dot or a
    back-tick. What run returns goes by its place."""
    plain = T.StructType([T.StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            yield pa.RecordBatch.from_arrays(b.columns, plain.names)

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(named, plain).toDF(*schema.names)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with as many underscores as no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(col: Column | str) -> Column:
    return F.encode(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")), "UTF-8")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64, copy=False).view(np.int64)
