"""Searching a topic from end to end: limits, search, candidates, review, cap, storing, the ledger."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import candidates, catalog, ledger, review
from ..schemas import NoResults, Options, RateLimited, TopicNotFound
from ..numbering import shared_path
from ..sources.edges import Answer, Provider, Reviewer


@dataclass(frozen=True)
class State:
    topics: DataFrame
    pages: DataFrame
    runs: DataFrame
    results: DataFrame


def search_topic(state: State, slug: str, name: str, provider: Provider, reviewer: Reviewer | None, now: datetime, options: Options = Options(), provider_name: str = "search", on_stage: Callable[[DataFrame], None] | None = None) -> tuple[State, Exception | None]:  # noqa: B008
    """The state afterwards, and what went wrong, if anything; a failed run is in the ledger too. on_stage
    is given the runs whenever this run comes to a stage: searching, reviewing, storing."""
    spark = state.topics.sparkSession
    topics = catalog.ensure_topics(state.topics, spark.createDataFrame([(slug, name)], "slug string, name string"), now)
    topics, runs = ledger.expire_stale(topics, state.runs, now, options.stale_after)
    topic_id = topics.filter(F.col("slug") == slug).first()["id"]
    run_id = runs.agg(F.coalesce(F.max("id"), F.lit(0)) + 1).first()[0]
    query = name + S.QUERY_SUFFIX
    if ledger.rate_limited(runs, now, options.min_interval):
        runs = ledger.insert_run(runs, run_id, topic_id, provider_name, query, "rate_limited", now)
        return replace(state, topics=topics, runs=runs), RateLimited(slug)

    def with_status(status: str) -> DataFrame:
        return catalog.put_topics(topics, spark.createDataFrame([(slug, name, status)], "slug string, name string, status string"), now)

    runs = ledger.insert_run(runs, run_id, topic_id, provider_name, query, "running", now, "searching")

    def reached(stage: str) -> None:
        if on_stage:
            on_stage(ledger.set_stage(runs, run_id, stage))

    reached("searching")
    held: list[DataFrame] = []
    answer = Answer(None)
    results, pages = state.results, state.pages
    try:
        found = provider.search(query, options.max_results * (2 if reviewer else 1)).withColumn("topic", F.lit(slug))
        rows = candidates.normalize_results(found).withColumn("source", F.col("host")).cache()
        held.append(rows)
        if not rows.limit(1).count():
            raise NoResults(slug)
        raw = rows.select(F.lit(topic_id).cast("long").alias("topic_id"), "url", F.lit(run_id).cast("long").alias("search_run_id"), "title", "source", "snippet", "rank")
        results = catalog.put_candidates(results, raw, now)
        if reviewer:
            reached("reviewing")
            given = reviewer.review(name, review.requests(rows))
            answer = given if isinstance(given, Answer) else Answer(given)
            seen = review.reviewed(rows, answer.rows.withColumn("topic", F.lit(slug)), options.min_score)
        else:
            seen = rows.withColumn("accepted", F.lit(True)).withColumn("review_order", F.col("candidate_index")).withColumn("page_type", F.lit("")).withColumn("reviewer_reason", F.lit(""))
        reached("storing")
        seen = review.final_ranks(review.capped(seen, options.max_results))
        top = pages.filter(F.col("topic_id") == topic_id).agg(F.coalesce(F.max("reading_order"), F.lit(0)) + 1).first()[0]
        seen = review.reading_orders(seen, F.lit(top)).withColumn("topic_id", F.lit(topic_id).cast("long")).withColumn("search_run_id", F.lit(run_id).cast("long")).cache()
        held.append(seen)
        total, stored = seen.agg(F.count("*"), F.count_if("accepted")).first()
        last = catalog.last_of(seen, ["topic_id", "url"], "review_order")
        pages = catalog.put_search_pages(pages, last.filter("accepted").select("topic_id", "url", "title", "source", "reading_order", "search_run_id"), now)
        ids = pages.select("topic_id", "url", F.col("id").alias("_page"))
        fields = last.join(ids, ["topic_id", "url"], "left").select("topic_id", "url", "search_run_id", "title", "source", "snippet", "rank", F.when(F.col("accepted"), F.col("_page")).alias("stored_as_page_id"), F.col("score").alias("reviewer_score"), "page_type", "reviewer_reason", "accepted")
        results = catalog.put_reviewed(results, fields, now)
        if not stored:
            raise NoResults(slug)
    except Exception as e:  # the run's failure is part of the state
        return State(_written(with_status("failed"), []), state.pages, _written(ledger.fail_run(runs, run_id, str(e), now), []), _written(results, held)), e
    finished = ledger.complete_run(runs, run_id, total, stored, now, answer.model, answer.tokens)
    after = State(_written(with_status("active"), []), _written(pages, []), _written(finished, []), _written(results, held))
    return after, None


def _written(df: DataFrame, held: list[DataFrame]) -> DataFrame:
    """df from the shared folder; what was held for it is let go."""
    path = shared_path(df, "state")
    df.write.parquet(path)
    for h in held:
        h.unpersist()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def process_topic(state: State, slug: str, provider: Provider, reviewer: Reviewer | None, now: datetime, options: Options = Options()) -> tuple[State, Exception | None]:  # noqa: B008
    """Search a queued or failed topic, unless the day's runs are used up."""
    if ledger.daily_limit_reached(state.runs, now, options.daily_limit):
        return state, RateLimited(slug)
    row = ledger.eligible(state.topics).filter(F.col("slug") == slug).first()
    if row is None:
        return state, TopicNotFound(slug)
    return search_topic(state, slug, row["name"], provider, reviewer, now, options)


def process_next(state: State, provider: Provider, reviewer: Reviewer | None, now: datetime, options: Options = Options()) -> tuple[State, Exception | None]:  # noqa: B008
    row = ledger.queue_head(state.topics).first()
    return process_topic(state, row["slug"], provider, reviewer, now, options) if row else (state, None)


def slug_of(spark, name: str) -> str:
    return spark.range(1).select(S.slugify(F.lit(name)).alias("s")).first()["s"]
