"""The search and review services over HTTP. A search is one small request, made by the driver; the
answers become DataFrames."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import BLOCKED_DOMAINS, PAGE_TYPES, REASON_LENGTH, REJECTED_PAGE_TYPES, CatalogError
from .edges import SEARCH_FIELDS, Answer, answer_text, decode_results, decode_reviews

#: url, headers, body and timeout to status and text.
Post = Callable[[str, dict[str, str], bytes, float], tuple[int, str]]


class ServiceError(CatalogError):
    """A service that can't be reached, refuses, or answers with what can't be read."""


def post(url: str, headers: dict[str, str], body: bytes, timeout: float) -> tuple[int, str]:
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers, method="POST"), timeout=timeout) as r:
            return r.status, r.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode(errors="replace")
    except OSError as e:
        raise ServiceError(f"no answer from {url}: {e}") from e


def read_answer(service: str, status: int | None, text: str) -> tuple[dict, str]:
    """A service's answer, which must be a JSON object, and what is wrong with it, if anything."""
    try:
        answer = json.loads(text)
    except ValueError as e:
        return {}, f"the {service} service's answer can't be read: {e}"
    if not isinstance(answer, dict):
        return {}, f"the {service} service's answer is no object"
    if not 200 <= (status or 0) < 300:
        told = answer.get("error") or ""
        told = told.get("message", "") if isinstance(told, dict) else told
        return {}, f"the {service} service failed: status {status}" + (f", {told}" if told else "")
    return answer, ""


def _asked(service: str, send: Post, endpoint: str, key: str, body: dict, timeout: float) -> tuple[str, dict]:
    if not key.strip():
        raise ServiceError(f"the {service} service needs a key")
    headers = {"Content-Type": "application/json", "Authorization": f"Bearer {key.strip()}"}
    status, text = send(endpoint, headers, json.dumps(body).encode(), timeout)
    answer, error = read_answer(service, status, text)
    if error:
        raise ServiceError(error)
    return text, answer


@dataclass(frozen=True)
class SearchService:
    """A Provider."""

    spark: SparkSession
    endpoint: str
    key: str
    timeout: float = 15.0
    send: Post = post

    def search(self, query: str, max_results: int = 10) -> DataFrame:
        body = {"query": query, **SEARCH_FIELDS, "max_results": max_results if max_results > 0 else 10, "exclude_domains": BLOCKED_DOMAINS}
        text, _ = _asked("search", self.send, self.endpoint, self.key, body, self.timeout)
        return decode_results(self.spark.createDataFrame([(text,)], "body string"))


#: What the reviewer is told unless the caller says it in other words.
PROMPT = (
    "You choose pages for engineers who read one technical page a day. Give each candidate a score from 0 to 100: "
    "how much is this very page worth reading on its own? Ask for store only pages that teach one concept, technique or feature in depth. "
    f"Whole books, front pages, lists of links and shallow lists get low scores; call their page_type one of {', '.join(REJECTED_PAGE_TYPES)}. Give a short reason in ASCII."
)


def review_body(topic: str, candidates: list[dict], model: str, prompt: str = PROMPT) -> dict:
    """The request of a review, with the schema that its answer must have."""
    kinds = {"index": {"type": "integer"}, "score": {"type": "integer", "minimum": 0, "maximum": 100}, "page_type": {"type": "string", "enum": PAGE_TYPES}, "should_store": {"type": "boolean"}, "reason": {"type": "string", "maxLength": REASON_LENGTH}}

    def strict(properties: dict) -> dict:
        return {"type": "object", "properties": properties, "required": list(properties), "additionalProperties": False}

    return {
        "model": model,
        "input": [{"role": "system", "content": prompt}, {"role": "user", "content": json.dumps({"topic": topic, "candidates": candidates})}],
        "text": {"format": {"type": "json_schema", "name": "page_review", "strict": True, "schema": strict({"results": {"type": "array", "items": strict(kinds)}})}},
        "store": False,
        "reasoning": {"effort": "low"},
        "max_output_tokens": 5000,
    }


@dataclass(frozen=True)
class ReviewService:
    """A Reviewer; candidates are those of one search, 20 at most by the options."""

    spark: SparkSession
    endpoint: str
    key: str
    model: str
    prompt: str = PROMPT
    timeout: float = 30.0
    send: Post = post

    def review(self, topic: str, candidates: DataFrame) -> Answer:
        rows = [r.asDict() for r in candidates.select("index", "title", "url", "source", "snippet", F.col("rank").alias("provider_rank")).orderBy("index").collect()]
        if not rows:
            return Answer(decode_reviews(self.spark.createDataFrame([], "body string")))
        text, answer = _asked("review", self.send, self.endpoint, self.key, review_body(topic, rows, self.model, self.prompt), self.timeout)
        found = answer_text(self.spark.createDataFrame([(text,)], "body string")).first()["text"]
        if not found:
            raise ServiceError(f"the review has no text: status {answer.get('status', '')}, {(answer.get('incomplete_details') or {}).get('reason', '')}")
        try:
            json.loads(found)
        except ValueError as e:
            raise ServiceError(f"the review can't be read: {e}") from e
        usage = answer.get("usage") or {}
        tokens = tuple(int(usage.get(f"{n}_tokens") or 0) for n in ("input", "output", "total"))
        return Answer(decode_reviews(self.spark.createDataFrame([(found,)], "body string")), answer.get("model") or "", tokens)
