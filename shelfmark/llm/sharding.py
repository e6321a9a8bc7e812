"""Reproducible shuffling into shards by a Feistel permutation of row numbers.

Rows get dense global numbers in the order of (doc_id, size, checksum), which no layout of the
input changes. A generalised Feistel network permutes [0, a*b) with a*b just above the row count;
cycle walking brings the few values beyond the count back. Shard and slot follow from the permuted
number alone: shard = p mod S, slot = p div S, so shard counts differ by one at most (law 'rows').

Edge cases: a null text counts as empty (size 1, checksum 0); rows with a null doc_id are kept and
come first; repeated rows each get a slot of their own; an empty table gives an empty result;
other columns of the input are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parallelism, stage, utf8

ROUNDS = 6


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Adds row_no, dense from 0 in the order of the columns, with no global sort in one task.

    Range partitions are sorted in place; the number of a row is the count in the partitions before
    it plus its place in its own. Only the partition counts meet in one task. A hidden tie-break
    lets a run of equal rows spread over partitions.
    """
    spark = rows.sparkSession
    dealt = (
        rows.withColumn("_tie", F.monotonically_increasing_id())
        .repartitionByRange(parallelism(spark), *order, "_tie")
        .sortWithinPartitions(*order, "_tie")
        .drop("_tie")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    dealt = stage(dealt, "numbered")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before, total = [], 0
    for part, n in sorted(counts.collect()):  # one row a partition
        before.append((part, total))
        total += n
    if not before:
        return dealt.withColumn("row_no", F.lit(0).cast("long")).drop("_part", "_place"), 0
    offsets = spark.createDataFrame(before, "_part int, _before long")
    return dealt.join(F.broadcast(offsets), "_part").withColumn("row_no", F.col("_before") + F.col("_place")).drop("_part", "_place", "_before"), total


def feistel(x: Column, a: int, b: int, seed: int) -> Column:
    """One pass of the network over [0, a*b): a bijection for any round function."""
    left = F.pmod(x, F.lit(a))
    start = F.struct(left.cast("long").alias("l"), F.call_function("div", x - left, F.lit(a)).cast("long").alias("r"))

    def turn(s: Column, k: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], k), F.lit(a)), F.lit(a))
        right = F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], k), F.lit(b)), F.lit(b))
        return F.struct(
            F.when(k % 2 == 0, left).otherwise(s["l"]).cast("long").alias("l"),
            F.when(k % 2 == 1, right).otherwise(s["r"]).cast("long").alias("r"),
        )

    keys = F.array(*[F.lit(2 * (seed * ROUNDS + i) + i % 2).cast("long") for i in range(ROUNDS)])
    end = F.aggregate(keys, start, turn)
    return end["l"] + end["r"] * a


def sides(n: int) -> tuple[int, int]:
    """a, b with a*b >= n and fewer than a values beyond n."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted(rows: DataFrame, number: str, n: int, seed: int = 0) -> Column:
    """The permuted number below n. The values beyond n, fewer than sqrt(n) + 1, are walked first to
    prove how often a walk can leave the range, so the unrolled walk below never ends early."""
    a, b = sides(n)
    outside = rows.sparkSession.range(n, a * b).select(F.col("id").alias("p"))
    steps = 0
    while steps < a * b - n and outside.limit(1).count():
        outside = outside.select(feistel(F.col("p"), a, b, seed).alias("p")).filter(F.col("p") >= n)
        steps += 1
    p = feistel(F.col(number), a, b, seed)
    if not steps:
        return p
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), p, lambda acc, _: F.when(acc < n, acc).otherwise(feistel(acc, a, b, seed)))


def shard_rows(docs: DataFrame, shards: int = 16, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of docs."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(utf8("text")).alias("text_crc32"),
    )
    rows, n = numbered(stage(slim, "sizes"), ["doc_id", "size", "text_crc32"])
    place = permuted(rows, "row_no", n, seed) if n else F.col("row_no")
    return rows.withColumn("_p", place).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"),
        F.call_function("div", F.col("_p"), F.lit(shards)).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
