"""What each filter of a chain does in every order of the chain: a direct relational replay.

Five filters judge every document once, each by itself. The flags are then crossed with the 120 orders
of the filters, which are broadcast; in each order the first filter that a document fails removes it.
Every crossed row is exploded into the five steps, and one aggregation by part, order and step counts
what is kept, removed and lost. Its partial sums are formed before the shuffle, of which there are at
most 600 for each part in a task, so the crossed rows never leave their task.

The duplicate filter needs the least doc_id of each text. Texts are compared by their sha256, and the
least ids are found by an aggregation with partial results. They go back to the documents by a join
in which a text that more than one row in SPREAD holds is matched by broadcast (there are fewer than
SPREAD of these) and its rows are dealt by their own digest, so no task gets more than a bounded share
for one text.

Edge cases: a null text counts as empty, so all null and empty texts are copies of one another; a null
lang is the part of the empty string; a row with a null doc_id has no smaller id and is none, so it
never fails as a copy; rows that share both doc_id and text are copies of neither; a document is good
or toxic if any row of labels with its doc_id says so, and neither without such a row; null labels
count for nothing; texts of any length are judged whole; repeated rows count each; no documents give
an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage

FILTERS = "ABCDE"
#: A text that more than one row in so many holds is matched by broadcast.
SPREAD = 1000


def judged(docs: DataFrame) -> DataFrame:
    """doc_id, part, copy (the text's digest) and for A to D whether the document fails."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("_t"))
    words = F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = rows.withColumn("_w", words).select("*", F.size("_w").alias("_n"), F.size(F.array_distinct("_w")).alias("_d"))
    capitals = F.length(F.regexp_replace("_t", "[^A-Z]+", ""))
    return rows.select(
        "doc_id", "part", F.sha2("_t", 256).alias("copy"),
        (F.col("_n") < 100).alias("A"),
        (100 * F.col("_d").cast("long") < 80 * F.col("_n").cast("long")).alias("B"),
        (100 * capitals.cast("long") > 10 * F.length("_t").cast("long")).alias("C"),
        F.col("_t").rlike("[#$%&*|]").alias("D"),
    )


def with_copies(rows: DataFrame, spread: int = SPREAD) -> DataFrame:
    """rows with E: whether a smaller doc_id has the same text."""
    least = rows.groupBy("copy").agg(F.min("doc_id").alias("_least"), F.count("*").alias("_n"))
    common = rows.count() // spread
    hot = least.filter(F.col("_n") > common).select("copy", F.col("_least").alias("_hot"))  # fewer than spread
    cold = least.filter((F.col("_n") > 1) & (F.col("_n") <= common)).select(F.col("copy").alias("_key"), "_least")
    dealt = rows.join(F.broadcast(hot), "copy", "left")
    own = F.concat(F.lit("-"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("copy"))  # no digest begins so
    dealt = dealt.withColumn("_key", F.when(F.col("_hot").isNull(), F.col("copy")).otherwise(own))
    found = dealt.join(cold, "_key", "left")
    return found.select(*rows.columns, F.coalesce(F.col("doc_id") > F.coalesce("_hot", "_least"), F.lit(False)).alias("E"))


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with good and toxic, as labels (doc_id, quality, toxic) says."""
    said = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    # a row without an id matches nothing, so it may be dealt anywhere
    key = F.coalesce("doc_id", -F.abs(F.xxhash64("copy", "part")) - 1)
    found = rows.withColumn("_id", key).join(said.withColumnRenamed("doc_id", "_id"), "_id", "left")
    real = F.col("doc_id").isNotNull()
    return found.select(*rows.columns, (real & F.coalesce("good", F.lit(False))).alias("good"), (real & F.coalesce("toxic", F.lit(False))).alias("toxic"))


def replayed(rows: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Counts by part, filter_order and step. rows: part, good, toxic, and whether each filter fails."""
    spark = rows.sparkSession
    orders = ["".join(p) for p in permutations(filters)]
    table = spark.createDataFrame([(i, o, *[o.index(f) + 1 for f in filters]) for i, o in enumerate(orders)], "_order int, filter_order string, " + ", ".join(f"_at_{f} int" for f in filters))
    steps = len(filters)
    # the place of the first failure, steps + 1 if there is none
    first = F.least(*[F.when(F.col(f), F.col(f"_at_{f}")).otherwise(steps + 1) for f in filters])
    fails = sum((F.col(f).cast("int") for f in filters[1:]), F.col(filters[0]).cast("int"))
    slim = rows.select("part", "good", "toxic", *filters, fails.alias("_fails"))
    crossed = slim.crossJoin(F.broadcast(table.drop("filter_order"))).withColumn("_first", first)  # 120 rows
    step = lambda k: F.struct(F.lit(k).alias("step"), _at(filters, k).alias("fails"))
    exploded = crossed.select("part", "_order", "good", "toxic", "_fails", "_first", F.inline(F.array(*[step(k) for k in range(1, steps + 1)])))
    removed = F.col("_first") == F.col("step")
    sums = exploded.groupBy("part", "_order", "step").agg(
        F.count_if(F.col("_first") > F.col("step")).alias("kept"),
        F.count_if(removed).alias("removed"),
        F.count_if(F.col("fails") & (F.col("_first") < F.col("step"))).alias("redundant"),
        F.count_if(F.col("fails") & (F.col("_fails") == 1)).alias("unique_fails"),
        F.count_if(removed & F.col("good")).alias("good_lost"),
        F.count_if(removed & F.col("toxic")).alias("toxic_lost"),
    )
    named = sums.join(F.broadcast(table.select("_order", "filter_order")), "_order").withColumn("_filter", F.substr("filter_order", F.col("step"), F.lit(1)))
    shares = named.groupBy("part", "_filter").agg(F.sum("removed").alias("shapley"))  # 120 rows each
    out = named.join(shares, ["part", "_filter"])
    return out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def _at(filters: str, k: int) -> Column:
    """Whether the document fails the filter that stands at place k of the crossed order."""
    out = F.lit(False)
    for f in filters:
        out = F.when(F.col(f"_at_{f}") == k, F.col(f)).otherwise(out)
    return out


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The replay of the five filters over docs. The flags are written once; the texts are read once."""
    rows = stage(judged(docs), "judged")
    return replayed(with_labels(with_copies(rows), labels))
