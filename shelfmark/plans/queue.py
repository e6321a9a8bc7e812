"""Searching all topics of the queue that the limits let through, in one plan.

The result is what `process_next` makes, called again and again with a clock that goes on by the least
interval, until the queue is empty or a limit stops it: topics are admitted first come first served
while the day of their start has runs left, and each keeps its own clock. All topics' candidates are
then ranked, reviewed, capped and stored together, by windows and joins on the topic; a topic whose
search or review fails is failed, and the others are not.
"""

from __future__ import annotations

from dataclasses import replace
from datetime import datetime
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..numbering import written
from ..operators import candidates, catalog, ledger, review
from ..schemas import COUNTED_STATUSES, Options, RateLimited
from ..sources.search_source import found_results, with_topics
from .search import State


class BatchProvider(Protocol):
    def search_all(self, queries: DataFrame, max_results: int) -> DataFrame:
        """topic, query, position, title, url, snippet, provider_score, attempts, error for queries
        (topic, query, topic_id); a row without position for a query that failed or found nothing. topic
        is to be handed back as it is: it's the slug, and more where other topics have the same one."""


class BatchReviewer(Protocol):
    def review_all(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Reviews of asked (topic, topic_id, name and the requests), and a row a topic with model, input_tokens, output_tokens, total_tokens and error."""


def admissions(topics: DataFrame, runs: DataFrame, now: datetime, options: Options, most: int) -> DataFrame:
    """topic_id, slug, name, place and started of the queued topics that the day's cap lets start, of the
    first `most`. The windows run over these only."""
    head = topics.filter("status = 'queued'").orderBy("created_at", "id").limit(most)
    placed = head.select(F.col("id").alias("topic_id"), "slug", "name", F.row_number().over(Window.orderBy("created_at", "id")).alias("place"))
    wait = F.make_dt_interval(secs=F.lit(options.min_interval.total_seconds()) * (F.col("place") - 1))
    timed = placed.withColumn("started", (S.at(now) + wait).cast("timestamp_ntz")).withColumn("day", F.to_date("started"))
    # of the ledger only what starts from today on is read; then a row a day, of it and of the starts
    later = runs.filter(F.col("status").isin(COUNTED_STATUSES) & (F.col("started_at") >= S.day_start(S.at(now)))).groupBy(F.to_date("started_at").alias("_day")).agg(F.count("*").alias("_n"))
    used = timed.select("day").distinct().join(F.broadcast(later), F.col("_day") >= F.col("day"), "left").groupBy("day").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n_runs"))
    same_day = F.row_number().over(Window.partitionBy("day").orderBy("place"))
    fits = timed.join(F.broadcast(used), "day").withColumn("_fits", F.col("n_runs") + same_day <= options.daily_limit)
    all_fit = F.min("_fits").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return fits.withColumn("_all", all_fit).filter("_all").select("topic_id", "slug", "name", "place", "started")


def _run_rows(runs: DataFrame, told: DataFrame, provider_name: str) -> DataFrame:
    made: dict[str, Column] = {
        "id": F.col("run_id"), "topic_id": F.col("topic_id"), "provider": F.lit(provider_name), "query": F.col("query"), "status": F.col("status"), "started_at": F.col("started"),
        "completed_at": F.col("started"), "result_count": F.col("total"), "stored_count": F.col("stored"), "error": F.col("error"), "reviewer_model": F.col("model"),
        "reviewer_input_tokens": F.col("input_tokens"), "reviewer_output_tokens": F.col("output_tokens"), "reviewer_total_tokens": F.col("total_tokens"), "stage": F.lit(""),
    }
    kinds = dict(runs.dtypes)
    return runs.unionByName(told.select(*[made[c].cast(kinds[c]).alias(c) for c in runs.columns]))


def process_queue(state: State, provider: BatchProvider, reviewer: BatchReviewer | None, now: datetime, options: Options = Options(), provider_name: str = "search", most: int = 1000) -> tuple[State, DataFrame | None, Exception | None]:  # noqa: B008
    """The state afterwards, a row for each topic that was searched (topic_id, slug, place, run_id,
    started, status, total, stored, error), or None if none was, and what stopped the whole, if anything."""
    if ledger.queue_head(state.topics).first() is None:
        return state, None, None
    if not admissions(state.topics, state.runs, now, options, 1).count():
        return state, None, RateLimited("the day's runs are used up")
    topics, runs = ledger.expire_stale(state.topics, state.runs, now, options.stale_after)
    topics = written(topics, "expired")
    top = runs.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    if ledger.rate_limited(runs, now, options.min_interval):
        row = ledger.queue_head(topics).first()
        runs = ledger.insert_run(runs, top + 1, row["id"], provider_name, row["name"] + S.QUERY_SUFFIX, "rate_limited", now)
        return replace(state, topics=topics, runs=runs), None, RateLimited(row["slug"])

    started = admissions(topics, runs, now, options, most).withColumn("run_id", (F.col("place") + top).cast("long")).withColumn("query", S.query_text(F.col("name")))
    # a topic is known by its id; the services know it by its slug, and where topics share one by that and the id
    alike = F.row_number().over(Window.partitionBy("slug").orderBy("place"))
    started = written(started.withColumn("topic", F.when(alike == 1, F.col("slug")).otherwise(F.concat_ws("\0", "slug", F.col("topic_id").cast("string")))), "admitted")
    rows = written(provider.search_all(started.select("topic", "query", "topic_id"), options.max_results * (2 if reviewer else 1)), "found")
    # dealt by topic once, for all the windows
    ranked = written(candidates.normalize_results(found_results(rows).repartition("topic")).withColumn("source", F.col("host")), "ranked")
    own = F.broadcast(started.select("topic", "topic_id", "name", "place", "started", F.col("run_id").alias("search_run_id")))  # as many rows as topics

    # the verdicts go with a candidate's key only, as its texts are many times as long
    judged = ranked.select("topic", "candidate_index", "url", "rank", "score")
    if reviewer:
        asked = review.requests(ranked).join(own.select("topic", "topic_id", "name"), "topic")
        given, told = reviewer.review_all(asked)
        told = written(told.select("topic", "model", "input_tokens", "output_tokens", "total_tokens", F.col("error").alias("review_error")), "reviewers")
        seen = review.reviewed(judged, given, options.min_score)
    else:
        told = None
        seen = judged.withColumnRenamed("candidate_index", "index").withColumn("accepted", F.lit(True)).withColumn("review_order", F.col("index")).withColumn("page_type", F.lit("")).withColumn("reviewer_reason", F.lit(""))
    # W4, W3, W5: by topic
    seen = review.final_ranks(review.capped(seen, options.max_results)).join(own, "topic").join(review.next_reading_order(state.pages), "topic_id", "left")
    seen = written(review.reading_orders(seen, F.coalesce("next_order", F.lit(1))), "seen")
    last = catalog.last_of(seen.drop("url"), ["topic", "index"], "review_order")
    texts = ranked.select("topic", F.col("candidate_index").alias("index"), "url", "title", "source")
    stored = texts.join(last.filter("accepted").select("topic", "topic_id", "index", "reading_order", "search_run_id", "place", "started"), ["topic", "index"])
    stored = written(stored.drop("topic", "index"), "stored")
    pages = catalog.put_search_pages(state.pages, stored, F.col("d.started"), by="place")
    pages = written(pages, "pages")

    # D8: every candidate is stored, and the last verdict on it, if there is one, in its place
    ids = pages.join(own.select("topic_id"), "topic_id", "left_semi").select("topic_id", "url", F.col("id").alias("_page"))
    verdict = last.select("topic", "index", F.col("rank").alias("_rank"), F.col("score").alias("reviewer_score"), F.col("page_type").alias("_type"), F.col("reviewer_reason").alias("_reason"), "accepted")
    every = ranked.drop("score").withColumnRenamed("candidate_index", "index").join(own.drop("name"), "topic").join(verdict, ["topic", "index"], "left").join(ids, ["topic_id", "url"], "left")
    fields = every.select("topic_id", "url", "search_run_id", "title", "source", "snippet", F.coalesce("_rank", "rank").alias("rank"), F.when(F.col("accepted"), F.col("_page")).alias("stored_as_page_id"), "reviewer_score", F.coalesce("_type", F.lit("")).alias("page_type"), F.coalesce("_reason", F.lit("")).alias("reviewer_reason"), F.coalesce("accepted", F.lit(False)).alias("accepted"), "place", "started")
    fields = written(fields, "fields")
    results = written(catalog.put_reviewed(state.results, fields, F.col("d.started"), by="place"), "results")

    # what became of each topic
    sums = seen.groupBy("topic").agg(F.count("*").alias("total"), F.count_if("accepted").alias("stored"))
    facts = started.join(with_topics(rows).select("topic", F.col("error").alias("search_error")), "topic", "left").join(sums, "topic", "left")
    if told is not None:
        facts = facts.join(told, "topic", "left")
    else:
        for name, value in (("model", ""), ("input_tokens", 0), ("output_tokens", 0), ("total_tokens", 0), ("review_error", "")):
            facts = facts.withColumn(name, F.lit(value))
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    stored = F.coalesce("stored", F.lit(0))
    error = F.when(blank("search_error") != "", F.col("search_error")).when(blank("review_error") != "", F.col("review_error")).when(stored == 0, F.col("slug")).otherwise("")
    facts = facts.withColumn("error", error)
    good = F.col("error") == ""
    kept = {"total": F.coalesce("total", F.lit(0)), "stored": stored, "model": blank("model")} | {c: F.coalesce(c, F.lit(0)) for c in ("input_tokens", "output_tokens", "total_tokens")}
    outcome = facts.select("topic_id", "slug", "name", "place", "run_id", "started", "query", "error", F.when(good, "completed").otherwise("failed").alias("status"), *[F.when(good, v).otherwise("" if n == "model" else 0).alias(n) for n, v in kept.items()])
    outcome = written(outcome, "outcome")
    changed = outcome.select("topic_id", F.when(F.col("status") == "completed", "active").otherwise("failed").alias("status"), F.col("started").alias("updated_at"))
    topics = written(catalog.set_status(topics, changed), "topics")
    after = State(topics, pages, written(_run_rows(runs, outcome, provider_name), "runs"), results)
    return after, outcome.select("topic_id", "slug", "place", "run_id", "started", "status", "total", "stored", "error"), None
