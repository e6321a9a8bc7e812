"""The listings: topic index, evaluations, status, and searches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import html_text, status_label
from .ledger import latest_runs


def topic_index(topics: DataFrame, results: DataFrame, runs: DataFrame) -> DataFrame:
    """Each topic that isn't disabled with its label, results and accepted results. Results and runs are
    summed up before the join."""
    counts = results.groupBy("topic_id").agg(F.count("*").alias("n_results"), F.sum(F.col("accepted").cast("long")).alias("n_accepted"))
    t = topics.filter("status <> 'disabled'").withColumnRenamed("id", "topic_id")
    rows = t.join(counts, "topic_id", "left").join(latest_runs(runs), "topic_id", "left")
    return rows.select(
        "topic_id", "slug", "name", "status", "updated_at", F.coalesce("n_results", F.lit(0)).alias("n_results"), F.coalesce("n_accepted", F.lit(0)).alias("n_accepted"),
        F.coalesce("run_status", F.lit("")).alias("run_status"), F.coalesce("run_stage", F.lit("")).alias("run_stage"),
        status_label(F.col("status"), F.col("run_status"), F.col("run_stage")).alias("label"),
        F.col("status").isin("queued", "failed").alias("can_process"), (F.col("status") == "searching").alias("is_processing"),
    )


def index_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc("updated_at"), "name", "slug")


def evaluations(results: DataFrame, topic_id: int | None = None) -> DataFrame:
    rows = results if topic_id is None else results.filter(F.col("topic_id") == topic_id)
    shown = rows.select(
        "id", "search_run_id", "title", "url", F.when(F.col("source") == "", "unknown source").otherwise(F.col("source")).alias("source"), "rank",
        F.coalesce("reviewer_score", F.lit(0)).alias("reviewer_score"), "page_type", "reviewer_reason", F.when(F.col("accepted"), "Accepted").otherwise("Rejected").alias("verdict"), "accepted",
    )
    return shown.orderBy(F.desc("search_run_id"), F.desc("accepted"), F.desc("reviewer_score"), "rank", "id")


def evaluations_of(topics: DataFrame, results: DataFrame, runs: DataFrame, slug: str) -> tuple[DataFrame, DataFrame]:
    """The header of a topic's evaluations (slug, name, status, label, n_evaluated, n_accepted), without a
    row if there is no such topic, and the evaluations."""
    own = topics.filter((F.col("slug") == slug) & (F.col("status") != "disabled"))
    rows = results.join(own.select(F.col("id").alias("topic_id")), "topic_id", "left_semi")
    head = topic_index(own, rows, runs).select("slug", "name", "status", "label", F.col("n_results").alias("n_evaluated"), "n_accepted")
    return head, evaluations(rows)


def topic_status(topics: DataFrame, runs: DataFrame, slug: str | None = None) -> DataFrame:
    """The status of one topic, or of every topic."""
    t = topics.filter("status <> 'disabled'" if slug is None else (F.col("slug") == slug) & (F.col("status") != "disabled")).withColumnRenamed("id", "topic_id")
    return t.join(latest_runs(runs), "topic_id", "left").select("slug", "name", "status", status_label(F.col("status"), F.col("run_status"), F.col("run_stage")).alias("label"), F.col("status").isin("queued", "failed").alias("can_process"))


def search_topics(topics: DataFrame, term: str = "", limit: int | None = 10, escape: bool = False) -> DataFrame:
    """Active topics whose slug or name holds the term; its wildcards work unless escape is set."""
    term = term.strip().lower()
    if escape:
        term = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    rows = topics.filter("status = 'active'")
    if term:
        rows = rows.filter(F.lower("slug").like(f"%{term}%") | F.lower("name").like(f"%{term}%"))
    rows = rows.select("slug", "name").orderBy("name", "slug")
    return rows.limit(limit) if limit else rows


def exact_topic(topics: DataFrame, term: str) -> DataFrame:
    """The topic with this slug, or else this name."""
    t = term.strip().lower()
    rows = topics.filter((F.col("status") == "active") & ((F.col("slug") == t) | (F.lower("name") == t)))
    return rows.orderBy(F.when(F.col("slug") == t, 0).otherwise(1), "name", "slug").limit(1)


def as_json(rows: DataFrame) -> DataFrame:
    """One row with a JSON array; of no rows, an empty one. The array is made in one task: rows are those
    of a listing, with a limit."""
    return rows.agg(F.coalesce(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("slug"), F.col("name"))))), F.lit("[]")).alias("body"))


def html_rows(rows: DataFrame, cells: list[str]) -> DataFrame:
    """rows with html, their cells as a row of a table."""
    tds = [F.concat(F.lit("<td>"), html_text(F.col(c)), F.lit("</td>")) for c in cells]
    return rows.withColumn("html", F.concat(F.lit("<tr>"), *tds, F.lit("</tr>")))


def as_html(rows: DataFrame, heading: str, cells: list[str]) -> DataFrame:
    """One row with a page of the cells, in their order, under a heading. The page is made in one task: rows
    are those of a listing, with a limit."""
    listed = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in cells], "html")))
    title = html_text(F.lit(heading))
    body = F.concat(F.lit("<h1>"), title, F.lit("</h1><table>"), F.array_join(F.transform(listed, lambda r: r["html"]), ""), F.lit("</table>"))
    head = F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><title>'), title, F.lit("</title></head><body>"))
    return html_rows(rows, cells).agg(F.concat(head, body, F.lit("</body></html>")).alias("body"))
