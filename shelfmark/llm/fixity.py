"""Fixity of WARC replicas by Merkle trees over records and offset ranges.

A record's digest covers its header and payload. The records that start in an offset range of a file
are hashed in order to a leaf; FANOUT adjoining ranges make the node above, up to the file's root;
files meet in a tree over the hex digits of their names' digests, up to one root. Two replicas are
compared from the root down: each level looks only at children of nodes that differ, and only the
records of differing leaves are compared one by one.

Edge cases: null urls and payloads count as empty; a null page_id goes to file -1; repeated rows
are records of their own at their own offsets; records that share a place in a manifest are hashed
with their count; an empty table gives an empty audit; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, stage

FANOUT = 16
RANGE = 256 << 10
RECORDS = 1024
DATE = "2024-01-01T00:00:00Z"


def header(url: Column, payload: Column) -> Column:
    """The WARC header of a resource record."""
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url,
        F.lit(f"\r\nWARC-Date: {DATE}\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"),
    )


def record(url: Column, payload: Column) -> Column:
    return F.concat(header(url, payload), payload, F.lit("\r\n\r\n"))


def placed(pages: DataFrame, extra: dict[str, Column] | None = None, records: int = RECORDS) -> DataFrame:
    """page_id, file, offset, length, digest: where each page's record lies. A file takes the pages of a
    range of page_ids, in order. extra: more columns, over url and html."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    whole = record(F.col("url"), F.col("html"))
    slim = rows.select(
        "page_id",
        F.concat(F.lit("part-"), F.lpad(F.coalesce(F.call_function("div", F.col("page_id"), F.lit(records)), F.lit(-1)).cast("string"), 10, "0"), F.lit(".warc")).alias("file"),
        F.octet_length(whole).cast("long").alias("length"),
        F.sha2(whole, 256).alias("digest"),
        *[c.alias(n) for n, c in (extra or {}).items()],
    )
    # a file may hold any number of rows (all pages without an id, or all that share one): its rows are
    # summed up by range partition, and each partition's share of a file starts after those before it
    order = ["file", "page_id", "digest", "_tie"]
    dealt = slim.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(parallelism(pages.sparkSession), *order)
    dealt = stage(dealt.withColumn("_part", F.spark_partition_id()), "placed")
    shares = dealt.groupBy("file", "_part").agg(F.sum("length").alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_sum")
    own = F.sum("length").over(Window.partitionBy("file", "_part").orderBy("page_id", "digest", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    starts = shares.select("file", "_part", before.alias("_before"))
    summed = dealt.withColumn("_own", own).join(starts, ["file", "_part"])
    return summed.withColumn("offset", F.col("_before") + F.col("_own") - F.col("length")).drop("_tie", "_part", "_own", "_before")


def _over(items: Column, *fields: str) -> Column:
    """The digest of sorted children."""
    return F.sha2(F.array_join(F.transform(F.array_sort(items), lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ","), 256)


def tree(manifest: DataFrame, range_bytes: int = RANGE) -> list[tuple[str, DataFrame]]:
    """Levels from the leaves to the root, for all values of the column `copy` at once. manifest: copy,
    file, offset, length, digest. A level has copy, file, at and hash; `at` counts ranges in a file."""
    counted = manifest.groupBy("copy", "file", "offset", "length", "digest").agg(F.count("*").alias("n"))
    at = F.call_function("div", F.col("offset"), F.lit(range_bytes)).alias("at")
    level = counted.groupBy("copy", "file", at).agg(_over(F.collect_list(F.struct("offset", "length", "digest", "n")), "offset", "length", "digest", "n").alias("hash"))
    levels = [("range", stage(level, "ranges"))]
    top, files = levels[0][1].agg(F.max("at"), F.approx_count_distinct("file")).first()
    children = F.collect_list(F.struct("at", "hash"))
    while top:
        top //= FANOUT
        up = F.call_function("div", F.col("at"), F.lit(FANOUT)).alias("at")
        levels.append(("range", stage(levels[-1][1].groupBy("copy", "file", up).agg(_over(children, "at", "hash").alias("hash")), "ranges")))
    digits = 0
    while FANOUT**digits < (files or 0):
        digits += 1
    named = F.collect_list(F.struct("file", "hash"))
    for d in range(digits, -1, -1):
        prefix = (F.substring(F.sha2("file", 256), 1, d) if d == digits else F.substring("file", 1, d)).alias("file")
        levels.append(("files" if d == digits else "prefix", stage(levels[-1][1].groupBy("copy", prefix).agg(_over(named, "file", "hash").alias("hash")).withColumn("at", F.lit(0).cast("long")), "files")))
    return levels


def _differ(nodes: DataFrame) -> DataFrame:
    """file, at of the nodes whose hashes differ, or that one side lacks."""
    side = [F.max(F.when(F.col("copy") == c, F.col("hash"))).alias(f"hash{c}") for c in (0, 1)]
    both = nodes.groupBy("file", "at").agg(*side).filter(~F.col("hash0").eqNullSafe(F.col("hash1")))
    return stage(both.select("file", "at"), "differ")  # so that each level's plan reads the one above, not all above


def locate(manifest: DataFrame, range_bytes: int = RANGE) -> DataFrame:
    """file, offset and verdict (altered, missing or extra in copy 1) of each record that differs."""
    levels = tree(manifest, range_bytes)
    bad = _differ(levels[-1][1])
    digits = sum(kind != "range" for kind, _ in levels) - 1
    for depth, (kind, nodes) in enumerate(reversed(levels[:-1])):  # depth: hex digits that name the parents
        parents = bad.select(F.col("file").alias("_f"), F.col("at").alias("_a"))
        if kind != "range":
            above = F.substring("file", 1, depth) == F.col("_f")
        elif depth == digits:
            above = F.substring(F.sha2("file", 256), 1, digits) == F.col("_f")
        else:
            above = (F.col("file") == F.col("_f")) & (F.call_function("div", F.col("at"), F.lit(FANOUT)) == F.col("_a"))
        bad = _differ(nodes.join(parents, above, "left_semi"))
    parents = bad.select(F.col("file").alias("_f"), F.col("at").alias("_a"))
    rows = manifest.join(parents, (F.col("file") == F.col("_f")) & (F.call_function("div", F.col("offset"), F.lit(range_bytes)) == F.col("_a")), "left_semi")
    counted = rows.groupBy("copy", "file", "offset", "length", "digest").agg(F.count("*").alias("n"))
    sides = [F.array_sort(F.collect_list(F.when(F.col("copy") == c, F.struct("length", "digest", "n")))) for c in (0, 1)]
    both = counted.groupBy("file", "offset").agg(*[F.when(F.size(s) > 0, s).alias(f"has{c}") for c, s in enumerate(sides)])
    both = both.filter(~F.col("has0").eqNullSafe(F.col("has1")))
    return both.select("file", "offset", F.when(F.col("has1").isNull(), "missing").when(F.col("has0").isNull(), "extra").otherwise("altered").alias("verdict"))


def audit(pages: DataFrame, damage: tuple[Column, Column], range_bytes: int = RANGE) -> DataFrame:
    """Audit a replica of the pages' WARC files. damage: over url and html, the replica's payload, and
    whether the replica lacks the record; replicas keep the places of the first copy's index.

    page_id, file, warc_offset, n_bytes, sha256 and verdict for each row of pages."""
    payload, lacks = damage
    rows = stage(placed(pages, {"digest1": F.sha2(F.concat(header(F.col("url"), F.col("html")), payload, F.lit("\r\n\r\n")), 256), "lacks": lacks}), "index")
    first = rows.select(F.lit(0).alias("copy"), "file", "offset", "length", "digest")
    second = rows.filter(~F.col("lacks")).select(F.lit(1).alias("copy"), "file", "offset", "length", F.col("digest1").alias("digest"))
    found = locate(first.unionByName(second), range_bytes)
    return rows.join(found, ["file", "offset"], "left").select("page_id", "file", F.col("offset").alias("warc_offset"), F.col("length").alias("n_bytes"), F.col("digest").alias("sha256"), F.coalesce("verdict", F.lit("intact")).alias("verdict"))
