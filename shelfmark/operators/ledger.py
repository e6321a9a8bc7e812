"""The run ledger: limits, the queue, stale runs, latest runs, and the run's own changes."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import at, day_start
from ..schemas import COUNTED_STATUSES, RUNS

STALE_ERROR = "stale running search timed out"


def latest_runs(runs: DataFrame) -> DataFrame:
    """topic_id, run_status, run_stage of each topic's latest run; ties go to the greater id."""
    latest = F.max_by(F.struct("status", "stage"), F.struct("started_at", "id"))
    return runs.groupBy("topic_id").agg(latest.alias("_r")).select("topic_id", F.col("_r.status").alias("run_status"), F.col("_r.stage").alias("run_stage"))


def runs_by_day(runs: DataFrame, limit: int = 20) -> DataFrame:
    counted = runs.filter(F.col("status").isin(COUNTED_STATUSES))
    return counted.groupBy(F.to_date("started_at").alias("day")).agg(F.count("*").alias("n_runs")).withColumn("reached", F.col("n_runs") >= limit)


def daily_limit_reached(runs: DataFrame, now: datetime, limit: int = 20) -> bool:
    start = day_start(at(now))
    return runs.filter(F.col("status").isin(COUNTED_STATUSES) & (F.col("started_at") >= start)).count() >= limit


def limited(running: Column, latest: Column, now: Column, interval: timedelta) -> Column:
    """Something runs, or the latest counted start is too recent."""
    return (running > 0) | F.coalesce(latest + F.make_dt_interval(secs=F.lit(interval.total_seconds())) > now, F.lit(False))


def rate_limited(runs: DataFrame, now: datetime, interval: timedelta) -> bool:
    counted = F.when(F.col("status").isin(COUNTED_STATUSES), F.col("started_at"))
    row = runs.agg(F.count_if(F.col("status") == "running").alias("r"), F.max(counted).alias("m")).select(limited(F.col("r"), F.col("m"), at(now), interval).alias("x")).first()
    return bool(row["x"])


def queue_head(topics: DataFrame) -> DataFrame:
    return topics.filter("status = 'queued'").orderBy("created_at", "id").limit(1)


def eligible(topics: DataFrame) -> DataFrame:
    return topics.filter(F.col("status").isin("queued", "failed"))


def expire_runs(runs: DataFrame, now: datetime, after: timedelta = timedelta(minutes=30)) -> DataFrame:
    """Running since before now - after: failed."""
    stale = (F.col("status") == "running") & (F.col("started_at") < at(now - after))
    return runs.select(
        *[
            {
                "status": F.when(stale, F.lit("failed")).otherwise(F.col("status")).alias("status"),
                "stage": F.when(stale, F.lit("")).otherwise(F.col("stage")).alias("stage"),
                "completed_at": F.when(stale, at(now)).otherwise(F.col("completed_at")).alias("completed_at"),
                "error": F.when(stale, F.lit(STALE_ERROR)).otherwise(F.col("error")).alias("error"),
            }.get(c, F.col(c))
            for c in runs.columns
        ]
    )


def orphans(topics: DataFrame, runs: DataFrame) -> DataFrame:
    """Searching topics that no running run belongs to."""
    running = runs.filter("status = 'running'").select(F.col("topic_id").alias("id"))
    return topics.filter("status = 'searching'").join(running, "id", "left_anti")


def expire_stale(topics: DataFrame, runs: DataFrame, now: datetime, after: timedelta = timedelta(minutes=30)) -> tuple[DataFrame, DataFrame]:
    new_runs = expire_runs(runs, now, after)
    gone = orphans(topics, new_runs).select("id", F.lit(True).alias("_gone"))
    joined = topics.join(gone, "id", "left")
    changed = joined.withColumn("status", F.when(F.col("_gone"), F.lit("failed")).otherwise(F.col("status"))).withColumn("updated_at", F.when(F.col("_gone"), at(now)).otherwise(F.col("updated_at")))
    return changed.select(*topics.columns), new_runs


def insert_run(runs: DataFrame, run_id: int, topic_id: int, provider: str, query: str, status: str, now: datetime, stage: str = "") -> DataFrame:
    done = None if status == "running" else now
    row = (run_id, topic_id, provider, query, status, now, done, 0, 0, "", "", 0, 0, 0, stage)
    return runs.unionByName(runs.sparkSession.createDataFrame([row], RUNS).select(*runs.columns))


def set_stage(runs: DataFrame, run_id: int, stage: str) -> DataFrame:
    return set_run(runs, run_id, {"stage": stage})


def set_run(runs: DataFrame, run_id: int, values: dict[str, object]) -> DataFrame:
    kinds = dict(runs.dtypes)
    here = F.col("id") == run_id
    return runs.select(*[F.when(here, F.lit(values[c]).cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in runs.columns])


def fail_run(runs: DataFrame, run_id: int, error: str, now: datetime) -> DataFrame:
    return set_run(runs, run_id, {"status": "failed", "stage": "", "completed_at": now, "error": error})


def complete_run(runs: DataFrame, run_id: int, found: int, stored: int, now: datetime, model: str = "", tokens: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    names = ("reviewer_input_tokens", "reviewer_output_tokens", "reviewer_total_tokens")
    return set_run(runs, run_id, {"status": "completed", "stage": "", "completed_at": now, "result_count": found, "stored_count": stored, "reviewer_model": model} | dict(zip(names, tokens, strict=True)))
