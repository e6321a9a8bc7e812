"""From search results to ranked candidates: drop, normalise, block, keep first occurrences, score, rank."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import bare_host, host_of, login_of, normal_path, strip_plain, url_authority, url_path, url_scheme
from ..functions.scoring import interest
from ..schemas import BLOCKED_DOMAINS


def _parsed(results: DataFrame) -> DataFrame:
    """Rows with a title and an http(s) URL, with the URL's parts; without a host the URL is none.

    A filter is evaluated where the rows are read, with all that it refers to written out in it, so this one
    refers to what is read. Each part is taken once, from the trimmed URL."""
    kept = results.filter(F.col("title").rlike(r"(?U)\S") & F.col("url").rlike(r"(?U)^\s*[hH][tT][tT][pP][sS]?://[^/?#]"))
    rows = kept.withColumn("title", strip_plain(F.col("title"))).withColumn("snippet", F.coalesce("snippet", F.lit(""))).withColumn("snippet", strip_plain(F.col("snippet"))).withColumn("_link", strip_plain(F.col("url")))
    rows = rows.withColumns({"_scheme": url_scheme(F.col("_link"), True), "_authority": url_authority(F.col("_link"), True), "_path": url_path(F.col("_link"), True)})
    user = F.col("_authority").contains("@")
    rows = rows.withColumns({"_login": F.when(user, login_of(F.col("_authority"))).otherwise(""), "host": F.lower(F.when(user, host_of(F.col("_authority"))).otherwise(F.col("_authority"))), "_path": normal_path(F.col("_path"))})
    return rows.withColumn("url", F.concat("_scheme", F.lit("://"), "_login", "host", "_path")).withColumn("rank", (F.col("position") + 1).cast("int")).drop("_link", "_scheme", "_authority", "_login")


def usable(results: DataFrame) -> DataFrame:
    """Rows with a title and an absolute http(s) URL, trimmed; rank is the provider's 1-based position."""
    return _parsed(results).filter("host <> ''").drop("_path")


def blocked(host: Column, url: Column, domains: list[str] | None = None) -> Column:
    """A blocked domain or one below it, or a PDF. The host keeps its port."""
    return _blocked(host, url_path(url), domains)


def _blocked(host: Column, path: Column, domains: list[str] | None) -> Column:
    domains = BLOCKED_DOMAINS if domains is None else domains
    own = bare_host(host).rlike(r"(?:^|\.)(?:" + "|".join(map(re.escape, domains)) + r")\z") if domains else F.lit(False)
    return own | F.lower(path).rlike(r"(?U)\.pdf\s*\z")


def first_occurrences(rows: DataFrame) -> DataFrame:
    """The first row of each normalised URL of a topic, in the provider's order."""
    order = Window.partitionBy("topic", "url").orderBy("position")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def normalize_results(results: DataFrame, domains: list[str] | None = None) -> DataFrame:
    """Candidates with score, in ranked order within each topic (candidate_index)."""
    # equal URLs have equal parts, so that their first row can be taken before these are looked at
    rows = first_occurrences(_parsed(results))
    rows = rows.filter((F.col("host") != "") & ~_blocked(F.col("host"), F.col("_path"), domains)).drop("_path")
    scored = rows.withColumn("score", interest(F.col("title"), F.col("url"), F.col("snippet"), F.col("host"), F.col("provider_score")))
    best = Window.partitionBy("topic").orderBy(F.desc("score"), F.asc("rank"))
    return scored.withColumn("candidate_index", F.row_number().over(best))
