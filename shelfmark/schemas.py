"""Declared schemas, options and errors."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta

TOPICS = "id long, slug string, name string, description string, status string, created_at timestamp_ntz, updated_at timestamp_ntz"
PAGES = (
    "id long, topic_id long, title string, url string, source string, official boolean, estimated_minutes int, difficulty string, evergreen_score int, reading_order int, "
    "active boolean, discovered_at timestamp_ntz, last_verified timestamp_ntz, verification_failures int, last_error string, search_run_id long, created_at timestamp_ntz, updated_at timestamp_ntz"
)
DAILY_READINGS = "id long, topic_id long, reading_date date, page_id long, created_at timestamp_ntz"
IMPORTS = "id long, topic string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, pages_found int, pages_imported int, error string"
RUNS = (
    "id long, topic_id long, provider string, query string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, result_count int, stored_count int, error string, "
    "reviewer_model string, reviewer_input_tokens int, reviewer_output_tokens int, reviewer_total_tokens int, stage string"
)
RESULTS = (
    "id long, topic_id long, search_run_id long, title string, url string, source string, snippet string, rank int, stored_as_page_id long, created_at timestamp_ntz, "
    "reviewer_score int, page_type string, reviewer_reason string, accepted boolean"
)
CANDIDATES = "topic string, position int, title string, url string, snippet string, provider_score double"
REVIEWS = "topic string, review_position int, index int, score int, page_type string, should_store boolean, reason string"
PROBES = "page_id long, http_status int, final_url string, error string"
SEED = "struct<topic:string, name:string, description:string, pages:array<struct<title:string, url:string, source:string, official:boolean, estimated_minutes:int, difficulty:string, evergreen_score:int>>>"

TABLES = {"topics": TOPICS, "pages": PAGES, "daily_readings": DAILY_READINGS, "imports": IMPORTS, "topic_search_runs": RUNS, "topic_search_results": RESULTS}

# The statuses that the tables may hold.
TOPIC_STATUSES = ["active", "queued", "searching", "failed", "disabled"]
RUN_STATUSES = ["running", "completed", "failed", "rate_limited"]
COUNTED_STATUSES = ["running", "completed", "failed"]

# Domains whose pages are never candidates.
BLOCKED_DOMAINS = ["facebook.com", "github.com", "instagram.com", "news.ycombinator.com", "reddit.com", "stackoverflow.com", "w3schools.com", "youtube.com"]

# Page types that a review may give and the gate refuses.
REJECTED_PAGE_TYPES = ["api", "landing", "listicle", "resource_list", "social"]

# Page types that a review may give, and the most characters of its reason.
PAGE_TYPES = ["guide", "tutorial", "concept", "reference", "api", "blog", "listicle", "resource_list", "landing", "social", "other"]
REASON_LENGTH = 240


@dataclass(frozen=True)
class Options:
    max_results: int = 10
    min_interval: timedelta = timedelta(minutes=5)
    min_score: int = 65
    daily_limit: int = 20
    stale_after: timedelta = timedelta(minutes=30)


class CatalogError(Exception):
    pass


class InvalidDate(CatalogError):
    pass


class NoActivePages(CatalogError):
    pass


class ReadingNotFound(CatalogError):
    pass


class TopicNotFound(CatalogError):
    pass


class RateLimited(CatalogError):
    pass


class NoResults(CatalogError):
    pass


class InvalidSeed(CatalogError):
    pass
