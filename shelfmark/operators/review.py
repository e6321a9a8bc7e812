"""Review verdicts: joining, the gate, the cap, and the final order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bare_host, sanitize_ascii, strip_plain, truncate_bytes, url_host, url_path
from ..schemas import REJECTED_PAGE_TYPES


def rejected_type(page_type: Column) -> Column:
    return F.lower(strip_plain(page_type)).isin(REJECTED_PAGE_TYPES)


def broad_url(url: Column) -> Column:
    """A site's front page, or a book's or course's entrance."""
    link = strip_plain(url)
    host, path = bare_host(url_host(link, True)), F.regexp_replace(F.lower(url_path(link, True)), "^/+|/+$", "")
    # Entrances by host.
    return (path == "") | ((host == "doc.rust-lang.org") & ((path == "book") | path.endswith("/book"))) | ((host == "rust-lang.org") & (path == "learn"))


def passes(should_store: Column, score: Column, page_type: Column, url: Column, min_score: int = 65) -> Column:
    return should_store & (score >= min_score) & ~rejected_type(page_type) & ~broad_url(url)


def requests(candidates: DataFrame) -> DataFrame:
    """What a reviewer sees."""
    return candidates.select("topic", F.col("candidate_index").alias("index"), "title", "url", "source", truncate_bytes(F.col("snippet"), 700).alias("snippet"), "rank")


def reviewed(candidates: DataFrame, reviews: DataFrame, min_score: int = 65) -> DataFrame:
    """Candidates that have a verdict, gated and ordered: accepted first, then score, then rank.

    A verdict of an unknown index is dropped, and so is a candidate without one; where an index is
    judged twice both rows stay."""
    rows = candidates.drop("score").withColumnRenamed("candidate_index", "index").join(reviews, ["topic", "index"])
    rows = rows.withColumn("accepted", passes(F.col("should_store"), F.col("score"), F.col("page_type"), F.col("url"), min_score))
    rows = rows.withColumn("page_type", strip_plain(F.col("page_type")))
    rows = rows.withColumn("reviewer_reason", sanitize_ascii(truncate_bytes(F.col("reason"), 500))).drop("reason")
    order = Window.partitionBy("topic").orderBy(F.desc("accepted"), F.desc("score"), F.asc("rank"), F.asc("review_position"))
    return rows.withColumn("review_order", F.row_number().over(order))


def capped(rows: DataFrame, most: int, order: str = "review_order", by: str = "topic") -> DataFrame:
    """Only the first `most` accepted rows of each topic stay accepted; below 1 there is no cap."""
    if most < 1:
        return rows
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("accepted", F.col("accepted") & (F.sum(F.col("accepted").cast("int")).over(w) <= most))


def final_ranks(rows: DataFrame, order: str = "review_order", by: str = "topic") -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(order)))


def reading_orders(rows: DataFrame, next_order: Column, order: str = "review_order", by: str = "topic") -> DataFrame:
    """Accepted rows get consecutive numbers from next_order on; the others none."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    number = next_order - 1 + F.sum(F.col("accepted").cast("int")).over(w)
    return rows.withColumn("reading_order", F.when(F.col("accepted"), number).cast("int"))


def next_reading_order(pages: DataFrame) -> DataFrame:
    return pages.groupBy("topic_id").agg((F.coalesce(F.max("reading_order"), F.lit(0)) + 1).cast("int").alias("next_order"))
