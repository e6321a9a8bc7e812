"""Link health: what probes do to pages."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import at
from ..numbering import shared_path
from ..sources.edges import probe_politely
from .moves import resolve_moves

THRESHOLD = 3


def healthy(status: Column, error: Column) -> Column:
    return F.coalesce(status.between(200, 399), F.lit(False)) & (F.coalesce(error, F.lit("")) == "")


def active_pages(pages: DataFrame) -> DataFrame:
    return pages.filter("active").select("id", "url").orderBy("id")


def apply_probes(pages: DataFrame, probes: DataFrame, now: datetime, threshold: int = THRESHOLD) -> DataFrame:
    """Pages after probes (page_id, http_status, final_url, error), with outcome: healthy, failed,
    disabled, conflict (the final URL is taken: the page keeps its own) or null if not probed. Pages that
    moved take their URLs in the order of their ids; see resolve_moves."""
    p = probes.select(F.col("page_id").alias("id"), "http_status", "final_url", F.col("error").alias("probe_error"), F.lit(True).alias("_probed"))
    rows = pages.join(p, "id", "left")
    good = F.col("_probed") & healthy(F.col("http_status"), F.col("probe_error"))
    bad = F.col("_probed") & ~healthy(F.col("http_status"), F.col("probe_error"))
    moved = good & (F.coalesce("final_url", "url") != F.col("url"))
    rows = rows.withColumn("_good", F.coalesce(good, F.lit(False))).withColumn("_bad", F.coalesce(bad, F.lit(False))).withColumn("_moved", F.coalesce(moved, F.lit(False)))
    got = resolve_moves(pages.select("id", "topic_id", "url"), rows.filter("_moved").select("id", "final_url"))
    rows = rows.join(got.withColumnRenamed("moved", "_got"), "id", "left")
    conflict = F.coalesce(~F.col("_got"), F.lit(False))
    failures = F.when(F.col("_bad"), F.col("verification_failures") + 1).when(F.col("_good"), F.lit(0)).otherwise(F.col("verification_failures"))
    off = F.col("_bad") & (failures >= threshold)
    reason = F.coalesce(F.nullif(F.col("probe_error"), F.lit("")), F.concat(F.lit("unexpected status "), F.col("http_status")), F.lit("no response"))
    changed = {
        "url": F.when(F.col("_moved") & ~conflict, F.col("final_url")).otherwise(F.col("url")),
        "verification_failures": failures.cast("int"),
        "last_error": F.when(F.col("_bad"), reason).when(F.col("_good"), F.lit("")).otherwise(F.col("last_error")),
        "last_verified": F.when(F.col("_probed"), at(now)).otherwise(F.col("last_verified")),
        "active": F.col("active") & ~off,
    }
    outcome = F.when(off, "disabled").when(F.col("_bad"), "failed").when(conflict, "conflict").when(F.col("_good"), "healthy")
    return rows.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in pages.columns], outcome.alias("outcome"))


def validate(pages: DataFrame, now: datetime, threshold: int = THRESHOLD, probe: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Scan the active pages, probe them, and apply what was found: the pages afterwards, with outcome,
    and the summary. The probes are made once and written, so both results tell of the same answers."""
    found = (probe or probe_politely)(active_pages(pages))
    path = shared_path(pages, "probes")
    found.write.parquet(path)
    after = apply_probes(pages, pages.sparkSession.read.schema(found.schema).parquet(path), now, threshold if threshold > 0 else THRESHOLD)
    return after, summary(after)


def summary(outcomes: DataFrame) -> DataFrame:
    o = F.col("outcome")
    return outcomes.agg(
        F.count_if(o.isNotNull()).alias("checked"), F.count_if(o.isin("healthy", "conflict")).alias("healthy"),
        F.count_if(o.isin("failed", "disabled")).alias("failed"), F.count_if(o == "disabled").alias("disabled"),
    )
