"""The heuristic score of a candidate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import bare_host

# Words that raise or lower the score, with their points.
TITLE_GOOD = ["guide", "tutorial", "concept", "deep dive", "ownership", "borrowing", "lifetime", "context", "transaction", "index"]
URL_GOOD = ["/book", "/guide", "/learn", "/docs", "/doc", "/reference", "/tutorial", "/manual"]
SNIPPET_GOOD = ["learn", "guide", "explain", "concept", "reference", "documentation", "tutorial"]
TITLE_BAD = ["why ", "gold standard", "homepage", "home page", "best ", "learn rust", "programming language"]
URL_BAD = ["web.mit.edu", "/releases", "/news", "/blog", "/tags", "/search"]
SNIPPET_BAD = ["mirror", "version 1."]
POINTS = {"title": 24, "url": 20, "snippet": 12, "docs_host": 24, "org": 10, "bad_title": -30, "bad_url": -30, "shallow": -10, "stale": -15}


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def interest(title: Column, url: Column, snippet: Column, host: Column, provider: Column) -> Column:
    """Each rule counts once. url is normalised; provider is the provider's score."""
    t, u, s, h = F.lower(title), F.lower(url), F.lower(snippet), bare_host(host)
    docs = h.contains("docs.") | h.contains("doc.") | h.startswith("developer.") | h.startswith("learn.")
    shallow = u.endswith("/") | (F.regexp_count(F.regexp_replace(u, "/$", ""), F.lit("/")) <= 2)
    rules = {
        "title": any_of(t, TITLE_GOOD), "url": any_of(u, URL_GOOD), "snippet": any_of(s, SNIPPET_GOOD),
        "docs_host": docs, "org": h.endswith(".org"), "bad_title": any_of(t, TITLE_BAD),
        "bad_url": any_of(u, URL_BAD), "shallow": shallow, "stale": any_of(s, SNIPPET_BAD),
    }
    start = (provider * 10).cast("int")
    return reduce(lambda a, k: a + F.when(rules[k], F.lit(POINTS[k])).otherwise(F.lit(0)), rules, start)
