"""JSON at the edges: search requests and answers, review requests and answers, link probes."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import url_host
from ..schemas import BLOCKED_DOMAINS

SEARCH_ANSWER = "results array<struct<title:string, url:string, content:string, score:double>>, error string"
REVIEW_ANSWER = "results array<struct<index:int, score:int, page_type:string, should_store:boolean, reason:string>>"


class Provider(Protocol):
    def search(self, query: str, max_results: int) -> DataFrame:
        """topic-less candidates: position, title, url, snippet, provider_score."""


@dataclass(frozen=True)
class Answer:
    """A review with the model that gave it and its tokens: input, output, total."""

    rows: DataFrame | None
    model: str = ""
    tokens: tuple[int, int, int] = (0, 0, 0)


class Reviewer(Protocol):
    def review(self, topic: str, candidates: DataFrame) -> DataFrame | Answer:
        """review_position, index, score, page_type, should_store, reason."""


# The search request's fields beside query, max_results and exclude_domains.
SEARCH_FIELDS = {
    "search_depth": "basic", "topic": "general", "include_answer": False, "include_raw_content": False,
    "include_images": False, "include_favicon": False, "include_usage": True,
}


def encode_requests(queries: DataFrame, max_results: int = 10) -> DataFrame:
    """Adds body, the request of each row's query."""
    fields = {n: F.lit(v) for n, v in SEARCH_FIELDS.items()} | {"max_results": F.lit(max_results), "exclude_domains": F.array(*[F.lit(x) for x in BLOCKED_DOMAINS])}
    return queries.withColumn("body", F.to_json(F.struct("query", *[c.alias(n) for n, c in fields.items()])))


def decode_results(answers: DataFrame) -> DataFrame:
    """Rows of body to candidates, with their place in the answer."""
    keys = [c for c in answers.columns if c != "body"]
    parsed = answers.select(*keys, F.from_json("body", SEARCH_ANSWER).alias("_a"))
    return parsed.select(*keys, F.posexplode("_a.results").alias("position", "_r")).select(*keys, "position", "_r.title", "_r.url", F.col("_r.content").alias("snippet"), F.col("_r.score").alias("provider_score"))


def decode_reviews(answers: DataFrame) -> DataFrame:
    keys = [c for c in answers.columns if c != "body"]
    parsed = answers.select(*keys, F.from_json("body", REVIEW_ANSWER).alias("_a"))
    return parsed.select(*keys, F.posexplode("_a.results").alias("review_position", "_r")).select(*keys, "review_position", "_r.*")


def answer_text(answers: DataFrame) -> DataFrame:
    """An answer's output_text, or else the texts of its parts (output[].content[].text), joined."""
    parsed = F.from_json("body", "output_text string, output array<struct<content:array<struct<text:string>>>>")
    texts = F.flatten(F.transform(parsed["output"], lambda o: F.transform(F.coalesce(o["content"], F.array().cast("array<struct<text:string>>")), lambda c: F.coalesce(c["text"], F.lit("")))))
    plain = F.nullif(F.trim(parsed["output_text"]), F.lit(""))
    return answers.withColumn("text", F.coalesce(plain, F.trim(F.array_join(texts, "")), F.lit("")))


def _probe(url: str | None, timeout: float) -> tuple[int | None, str | None, str]:
    """Status, final URL and error of one page: HEAD, or GET where HEAD isn't allowed; redirects are followed."""
    import urllib.error
    import urllib.request

    for method in ("HEAD", "GET"):
        try:
            with urllib.request.urlopen(urllib.request.Request(url or "", method=method), timeout=timeout) as r:
                return r.status, r.url, ""
        except urllib.error.HTTPError as e:
            if e.code == 405 and method == "HEAD":
                continue
            return e.code, url, ""
        except Exception as e:  # noqa: BLE001  a probe's failure is its result
            return None, url, str(e) or type(e).__name__
    return None, url, "no answer"


PROBED = "page_id long, http_status int, final_url string, error string"


def _probed(ids, got):
    import pandas as pd

    return pd.DataFrame({"page_id": ids, "http_status": pd.array([g[0] for g in got], dtype="Int32"), "final_url": [g[1] for g in got], "error": [g[2] for g in got]})


def probe_links(pages: DataFrame, timeout: float = 10.0) -> DataFrame:
    """The probes of pages (id, url), one after another in each task."""

    def run(batches):
        for b in batches:
            yield _probed(b["id"], [_probe(u, timeout) for u in b["url"]])

    return pages.select("id", "url").mapInPandas(run, PROBED)


def probe_politely(pages: DataFrame, at_once: int = 64, in_flight: int = 8, delay: float = 0.2, timeout: float = 10.0) -> DataFrame:
    """The probes of pages (id, url), some at once, but never two of one host, and a host's requests start
    at least `delay` seconds apart. All pages of a host are one task's, so this holds over all tasks: a
    host's own pages take as long as its delay demands, whatever the cluster's size. at_once bounds the
    requests in flight over all tasks, in_flight those of one."""
    width = max(1, min(in_flight, at_once))

    def run(batches):
        import time
        from concurrent.futures import ThreadPoolExecutor

        last: dict[str, float] = {}  # when the host was last asked

        def lane(host: str, urls: list) -> list:
            out = []
            for u in urls:
                wait = last.get(host, 0.0) + delay - time.monotonic()
                if host and wait > 0:
                    time.sleep(wait)
                last[host] = time.monotonic()
                out.append(_probe(u, timeout))
            return out

        with ThreadPoolExecutor(width) as pool:
            for b in batches:
                lanes = list(b.groupby("host", sort=False))  # a host is one lane, and its pages follow one another
                for (_, rows), got in zip(lanes, pool.map(lambda x: lane(x[0], x[1]["url"].tolist()), lanes), strict=True):
                    yield _probed(rows["id"], got)

    host = F.coalesce(url_host(F.col("url")), F.lit(""))
    return pages.select("id", "url", host.alias("host")).repartition(max(1, at_once // width), "host").mapInPandas(run, PROBED)
