"""The operators bound to the test tables, each with SQL that must give the same rows.

Roles: pages are candidates (topic: first path segment), events the run ledger, customer the topics,
part the catalog, orders the assignments, labels with documents the review verdicts.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions import scoring
from ..numbering import number_rows
from ..schemas import RUNS
from ..operators import candidates, catalog, ledger, links, review, rotation, views

NOW = datetime(2024, 1, 15, 12)
#: The defaults block no host of the test pages, so hosts of theirs are blocked here.
BLOCKED = ["example.org", "example.net"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def T(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_ODD_URLS = ["HTTP://WWW.Example.COM/A.PDF?x=1#y", "ftp://a.b/c", "no url", "https://h.example.com/", "https://h.example.com", " ", "https://x.example.com/a/b///", "https://Me:pw@example.org/in/side/", "https://me@H.example.com/a", "https://me@/a"]


def page_results(spark: SparkSession, d: str) -> DataFrame:
    """Candidates from pages, and some rows that the pages lack: a PDF, bad URLs, blank titles."""
    p = T(spark, d, "pages")
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    rows = p.select(
        F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?#]*)", 1).alias("topic"), F.col("page_id").cast("int").alias("position"), title.alias("title"), "url",
        F.regexp_replace("html", "<[^>]*>", " ").alias("snippet"), (F.pmod("page_id", F.lit(100)) / 100.0).alias("provider_score"),
    )
    odd = spark.createDataFrame([("odd", i, "" if i == 6 else f"Guide {i}", u, "learn", 0.5) for i, u in enumerate(_ODD_URLS)], rows.schema)
    return rows.unionByName(odd)


_ODD_SQL = ", ".join(f"('odd', {i}, '{'' if i == 6 else f'Guide {i}'}', '{u}', 'learn', 0.5)" for i, u in enumerate(_ODD_URLS))
_RESULTS = f"""results AS (
  SELECT regexp_extract(url, '^[a-z]+://[^/]+/([^/?#]*)', 1) AS topic, CAST(page_id AS INTEGER) AS position, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, url,
    regexp_replace(html, '<[^>]*>', ' ', 'g') AS snippet, (page_id % 100) / 100.0::DOUBLE AS provider_score FROM pages
  UNION ALL SELECT * FROM (VALUES {_ODD_SQL}) v(topic, position, title, url, snippet, provider_score))"""
_STRIP = lambda x: f"regexp_replace({x}, '^[\\s\\x{{00A0}}]+|[\\s\\x{{00A0}}]+$', '', 'g')"
_RX = r"'^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]+)([^?#]*)'"
_USABLE = f"""{_RESULTS}, parts AS (
  SELECT *, lower(regexp_extract(trim(url), {_RX}, 1)) AS scheme, lower(regexp_extract(trim(url), {_RX}, 2)) AS host, regexp_extract(trim(url), {_RX}, 3) AS path FROM results),
authority AS (SELECT * REPLACE (regexp_replace(host, '^.*@', '') AS host), regexp_extract(regexp_extract(trim(url), {_RX}, 2), '^.*@') AS login FROM parts),
usable AS (
  SELECT topic, position, {_STRIP('title')} AS title, scheme || '://' || login || host || CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END AS url, {_STRIP('snippet')} AS snippet, provider_score, host, CAST(position + 1 AS INTEGER) AS rank,
    CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END AS path
  FROM authority WHERE {_STRIP('title')} <> '' AND scheme IN ('http', 'https') AND host <> '')"""
_BARE = "regexp_replace(host, '^www\\.', '')"
_IS_BLOCKED = "(" + " OR ".join(f"{_BARE} = '{b}' OR {_BARE} LIKE '%.{b}'" for b in BLOCKED) + " OR lower(path) LIKE '%.pdf')"


def _has(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), '{w}')" for w in words) + ")"


# written out here, so that a wrong list or point in the operator shows
_SCORE = f"""CAST(trunc(provider_score * 10) AS INTEGER)
  + CASE WHEN {_has('title', ['guide', 'tutorial', 'concept', 'deep dive', 'ownership', 'borrowing', 'lifetime', 'context', 'transaction', 'index'])} THEN 24 ELSE 0 END
  + CASE WHEN {_has('url', ['/book', '/guide', '/learn', '/docs', '/doc', '/reference', '/tutorial', '/manual'])} THEN 20 ELSE 0 END
  + CASE WHEN {_has('snippet', ['learn', 'guide', 'explain', 'concept', 'reference', 'documentation', 'tutorial'])} THEN 12 ELSE 0 END
  + CASE WHEN contains({_BARE}, 'docs.') OR contains({_BARE}, 'doc.') OR starts_with({_BARE}, 'developer.') OR starts_with({_BARE}, 'learn.') THEN 24 ELSE 0 END
  + CASE WHEN {_BARE} LIKE '%.org' THEN 10 ELSE 0 END
  + CASE WHEN {_has('title', ['why ', 'gold standard', 'homepage', 'home page', 'best ', 'learn rust', 'programming language'])} THEN -30 ELSE 0 END
  + CASE WHEN {_has('url', ['web.mit.edu', '/releases', '/news', '/blog', '/tags', '/search'])} THEN -30 ELSE 0 END
  + CASE WHEN url LIKE '%/' OR len(regexp_replace(url, '/$', '')) - len(replace(regexp_replace(url, '/$', ''), '/', '')) <= 2 THEN -10 ELSE 0 END
  + CASE WHEN {_has('snippet', ['mirror', 'version 1.'])} THEN -15 ELSE 0 END"""
_RANKED = f"""{_USABLE}, firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic, url ORDER BY position) AS n FROM usable WHERE NOT {_IS_BLOCKED}) WHERE n = 1),
scored AS (SELECT *, {_SCORE} AS score FROM firsts),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic ORDER BY score DESC, rank) AS INTEGER) AS candidate_index FROM scored)"""


@query(f"WITH {_RESULTS}, parts AS (SELECT *, lower(regexp_extract(trim(url), {_RX}, 1)) AS scheme, regexp_replace(lower(regexp_extract(trim(url), {_RX}, 2)), '^.*@', '') AS host, regexp_extract(regexp_extract(trim(url), {_RX}, 2), '^.*@') AS login, regexp_extract(trim(url), {_RX}, 3) AS path FROM results) "
       "SELECT topic, position, host, CASE WHEN scheme IN ('http','https') AND host <> '' THEN scheme || '://' || login || host || CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/+$', '') END END AS normalized FROM parts")  # fmt: skip
def normalize_url(spark, d):
    return page_results(spark, d).select("topic", "position", S.url_host(F.col("url")).alias("host"), S.normalize_url(F.col("url")).alias("normalized"))


@query(f"WITH {_USABLE} SELECT topic, url, min(position) AS position, min_by(title, position) AS title FROM usable GROUP BY topic, url")
def dedup_first_occurrence(spark, d):
    return candidates.first_occurrences(candidates.usable(page_results(spark, d))).select("topic", "url", "position", "title")


@query(f"WITH {_USABLE} SELECT topic, position, url, {_IS_BLOCKED} AS blocked FROM usable")
def blocklist_filter(spark, d):
    return candidates.usable(page_results(spark, d)).select("topic", "position", "url", candidates.blocked(F.col("host"), F.col("url"), BLOCKED).alias("blocked"))


_BROAD = "regexp_replace(lower(path), '^/+|/+$', '', 'g')"


@query(f"WITH {_USABLE} SELECT topic, position, ({_BROAD} = '') OR ({_BARE} = 'doc.rust-lang.org' AND ({_BROAD} = 'book' OR {_BROAD} LIKE '%/book')) OR ({_BARE} = 'rust-lang.org' AND {_BROAD} = 'learn') AS broad FROM usable")
def broad_url_flag(spark, d):
    return candidates.usable(page_results(spark, d)).select("topic", "position", review.broad_url(F.col("url")).alias("broad"))


@query(f"WITH {_USABLE} SELECT topic, position, {_SCORE} AS score FROM usable")
def interestingness_score(spark, d):
    u = candidates.usable(page_results(spark, d))
    return u.select("topic", "position", scoring.interest(F.col("title"), F.col("url"), F.col("snippet"), F.col("host"), F.col("provider_score")).alias("score"))


@query(f"WITH {_RANKED} SELECT topic, url, title, host AS source, rank, score, candidate_index FROM ranked")
def candidate_pipeline(spark, d):
    return candidates.normalize_results(page_results(spark, d), BLOCKED).select("topic", "url", "title", F.col("host").alias("source"), "rank", "score", "candidate_index")


_SLUG = "regexp_replace(regexp_replace(lower(trim(c_name)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"


@query(f"SELECT c_custkey, {_SLUG} AS slug, array_to_string(list_transform(list_filter(regexp_split_to_array({_SLUG}, '[-_]'), lambda p: p <> ''), lambda p: upper(p[1]) || p[2:]), ' ') AS display, c_name || ' specific concept tutorial guide deep dive documentation' AS query FROM customer")
def slug_and_names(spark, d):
    slug = S.slugify(F.col("c_name"))
    return T(spark, d, "customer").select("c_custkey", slug.alias("slug"), S.display_name(slug).alias("display"), S.query_text(F.col("c_name")).alias("query"))


@query("SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^\\x20-\\x7E]', '', 'g'), ' +', ' ', 'g')) AS ascii FROM documents")
def sanitize_ascii(spark, d):
    return T(spark, d, "documents").select("doc_id", S.sanitize_ascii(F.col("text")).alias("ascii"))


# the longest prefix of whole characters that fits; what is left of a split character is one U+FFFD
@query(f"""WITH t AS (SELECT doc_id, {_STRIP('text')} AS t FROM documents), k AS (SELECT doc_id, t, list_max(list_filter(range(0, 701), lambda n: strlen(left(t, n)) <= 700)) AS k FROM t),
c AS (SELECT doc_id, left(t, k) || CASE WHEN length(t) > k AND strlen(left(t, k)) < 700 THEN chr(65533) ELSE '' END AS cut FROM k) SELECT doc_id, {_STRIP('cut')} AS cut FROM c""")
def truncate_bytes(spark, d):
    return T(spark, d, "documents").select("doc_id", S.truncate_bytes(F.col("text"), 700).alias("cut"))


def verdicts(spark, d):
    """Review rows of documents: score from the length, order by document."""
    docs, labels = T(spark, d, "documents").select("doc_id", "source", "n_chars"), T(spark, d, "labels")
    rows = docs.join(labels, "doc_id").select(
        "doc_id", F.col("source").alias("topic"), (F.col("n_chars") % 101).cast("int").alias("score"), (F.col("quality") == 1).alias("should_store"),
        F.when(F.col("toxic") == 1, "listicle").otherwise("article").alias("page_type"), F.concat(F.lit("https://docs.example.com/"), F.when(F.col("doc_id") % 10 == 3, "").otherwise(F.col("doc_id").cast("string"))).alias("url"),
    )
    passed = rows.withColumn("accepted", review.passes(F.col("should_store"), F.col("score"), F.col("page_type"), F.col("url"), 40))
    return passed.withColumn("review_order", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("accepted"), F.desc("score"), "doc_id")))


_VERDICTS = """v AS (SELECT doc_id, source AS topic, CAST(n_chars % 101 AS INTEGER) AS score, quality = 1 AND n_chars % 101 >= 40 AND toxic <> 1 AND doc_id % 10 <> 3 AS accepted FROM documents JOIN labels USING (doc_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY accepted DESC, score DESC, doc_id) AS review_order FROM v)"""


@query(f"WITH {_VERDICTS} SELECT doc_id, topic, score, accepted, CAST(review_order AS INTEGER) AS review_order FROM o")
def review_gate(spark, d):
    return verdicts(spark, d).select("doc_id", "topic", "score", "accepted", "review_order")


@query(f"""WITH {_RANKED}, reviews AS (SELECT topic, candidate_index AS index, CAST((position * 37) % 101 AS INTEGER) AS score, CASE WHEN position % 7 = 0 THEN ' Landing' ELSE 'guide' END AS page_type, position % 5 <> 0 AS should_store, position AS review_position FROM ranked WHERE position % 11 <> 0
  UNION ALL SELECT 'en', 1000000, 99, 'guide', true, 1),
j AS (SELECT r.topic, r.url, r.rank, v.score, v.review_position, v.should_store AND v.score >= 65 AND v.page_type <> ' Landing' AND NOT {_BROAD} = '' AS accepted FROM ranked r JOIN reviews v ON r.topic = v.topic AND r.candidate_index = v.index)
SELECT topic, url, score, accepted, CAST(row_number() OVER (PARTITION BY topic ORDER BY accepted DESC, score DESC, rank, review_position) AS INTEGER) AS review_order FROM j""")
def review_join(spark, d):
    c = candidates.normalize_results(page_results(spark, d), BLOCKED)
    p = F.col("position")
    verdict = c.filter(p % 11 != 0).select(
        "topic", F.col("candidate_index").alias("index"), ((p * 37) % 101).cast("int").alias("score"), F.when(p % 7 == 0, " Landing").otherwise("guide").alias("page_type"),
        (p % 5 != 0).alias("should_store"), p.alias("review_position"), F.lit("reason é").alias("reason"),
    )
    stray = spark.createDataFrame([("en", 1000000, 99, "guide", True, 1, "none")], verdict.schema)
    return review.reviewed(c, verdict.unionByName(stray)).select("topic", "url", "score", "accepted", "review_order")


@query(f"WITH {_VERDICTS} SELECT doc_id, topic, accepted AND sum(accepted::INT) OVER (PARTITION BY topic ORDER BY review_order) <= 5 AS accepted FROM o")
def cap_accepted(spark, d):
    return review.capped(verdicts(spark, d), 5).select("doc_id", "topic", "accepted")


@query(f"WITH {_VERDICTS} SELECT doc_id, topic, CASE WHEN accepted THEN CAST(10 + sum(accepted::INT) OVER (PARTITION BY topic ORDER BY review_order) AS INTEGER) END AS reading_order FROM o")
def running_reading_order(spark, d):
    return review.reading_orders(verdicts(spark, d), F.lit(11)).select("doc_id", "topic", "reading_order")


@query("SELECT p_brand AS topic_id, CAST(max(p_partkey) + 1 AS INTEGER) AS next_order FROM part GROUP BY p_brand")
def next_reading_order(spark, d):
    return review.next_reading_order(T(spark, d, "part").select(F.col("p_brand").alias("topic_id"), F.col("p_partkey").alias("reading_order")))


def catalog_pages(spark, d):
    return T(spark, d, "part").select(F.col("p_brand").alias("topic_id"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("reading_order"), (F.col("p_size") > 5).alias("active"))


def _rotation_sql(days: str) -> str:
    return f"""WITH a AS (SELECT p_brand AS topic_id, p_partkey AS page_id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS turn, count(*) OVER (PARTITION BY p_brand) AS n FROM part WHERE p_size > 5),
days AS ({days}) SELECT topic_id, reading_date, page_id FROM a, days WHERE turn = ((date_diff('day', DATE '1970-01-01', reading_date) % n) + n) % n"""


@query(_rotation_sql("SELECT DATE '2024-06-27' AS reading_date"))
def daily_rotation(spark, d):
    p = catalog_pages(spark, d)
    return rotation.rotation(p, p.select("topic_id").distinct().withColumn("reading_date", F.lit("2024-06-27").cast("date")))


@query(_rotation_sql("SELECT CAST(unnest(generate_series(DATE '1969-12-20', DATE '1970-02-10', INTERVAL 1 DAY)) AS DATE) AS reading_date"))
def rotation_range(spark, d):
    p = catalog_pages(spark, d)
    span = F.explode(F.sequence(F.lit("1969-12-20").cast("date"), F.lit("1970-02-10").cast("date")))
    return rotation.rotation(p, p.select("topic_id").distinct().select("topic_id", span.alias("reading_date")))


def assignments(spark, d):
    o = T(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("topic_id"), F.to_date("o_orderdate").alias("reading_date"), (F.col("o_orderkey") % 200 + 1).alias("page_id"), F.col("o_orderdate").alias("created_at"))


@query("SELECT o_custkey AS topic_id, CAST(o_orderdate AS DATE) AS reading_date, min(o_orderkey) AS id, min_by(o_orderkey % 200 + 1, o_orderkey) AS page_id FROM orders GROUP BY 1, 2")
def first_assignment(spark, d):
    return rotation.first_writers(assignments(spark, d))


@query("SELECT o_orderkey AS id, c_name AS topic_name, p_name AS title, CAST(o_orderdate AS DATE) AS reading_date FROM orders JOIN customer ON c_custkey = o_custkey JOIN part ON p_partkey = o_orderkey % 200 + 1")
def assigned_reading_lookup(spark, d):
    t = T(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("slug"), F.col("c_name").alias("name"))
    p = T(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), *[F.lit(None).cast("string").alias(c) for c in ("url", "source", "official", "estimated_minutes", "difficulty")])
    return rotation.with_details(assignments(spark, d), t, p).select("id", "topic_name", "title", "reading_date")


@query("""WITH a AS (SELECT p_size AS topic_id, p_partkey AS page_id, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS turn, count(*) OVER (PARTITION BY p_size) AS n FROM part),
stored AS (SELECT o_custkey AS topic_id, CAST(o_orderdate AS DATE) AS reading_date, min(o_orderkey) AS id, min_by(o_orderkey % 200 + 1, o_orderkey) AS page_id FROM orders GROUP BY 1, 2),
wanted AS (SELECT c_custkey AS topic_id, CAST(d AS DATE) AS reading_date FROM customer, unnest(generate_series(DATE '1995-01-01', DATE '1995-03-01', INTERVAL 1 DAY)) u(d)),
missing AS (SELECT w.* FROM wanted w ANTI JOIN stored s USING (topic_id, reading_date) JOIN customer c ON c.c_custkey = w.topic_id WHERE c_mktsegment = 'BUILDING'),
made AS (SELECT m.topic_id, m.reading_date, a.page_id FROM missing m JOIN a ON a.topic_id = m.topic_id AND a.turn = date_diff('day', DATE '1970-01-01', m.reading_date) % a.n)
SELECT id, topic_id, reading_date, page_id FROM stored UNION ALL
SELECT CAST((SELECT max(id) FROM stored) + row_number() OVER (ORDER BY topic_id, reading_date) AS BIGINT), topic_id, reading_date, page_id FROM made""")
def get_or_create_reading(spark, d):
    pages = T(spark, d, "part").select(F.col("p_size").cast("long").alias("topic_id"), F.col("p_partkey").alias("id"), F.col("p_partkey").alias("reading_order"), F.lit(True).alias("active"))
    topics = T(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") == "BUILDING", "active").otherwise("failed").alias("status"))
    stored = rotation.first_writers(assignments(spark, d)).withColumn("created_at", S.at(NOW))
    span = F.explode(F.sequence(F.lit("1995-01-01").cast("date"), F.lit("1995-03-01").cast("date")))
    wanted = topics.select(F.col("id").alias("topic_id"), span.alias("reading_date"))
    return rotation.get_or_create(stored, wanted, topics, pages, NOW).drop("created_at")


def runs(spark, d):
    kind = F.col("event_type")
    status = F.when(kind == "view", "running").when(kind.isin("click", "purchase"), "completed").when(kind == "error", "failed").otherwise("rate_limited")
    stage = F.when(F.col("event_id") % 3 == 0, "reviewing").otherwise("")
    none = F.lit(None).cast("timestamp_ntz")
    return T(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("topic_id"), status.alias("status"), F.col("ts").alias("started_at"), stage.alias("stage"), none.alias("completed_at"), F.lit("").alias("error"))


_RUNS = """runs AS (SELECT event_id AS id, user_id AS topic_id, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'rate_limited' END AS status,
  ts AS started_at, CASE WHEN event_id % 3 = 0 THEN 'reviewing' ELSE '' END AS stage FROM events)"""
_LATEST = "latest AS (SELECT topic_id, max_by(status, (started_at, id)) AS run_status, max_by(stage, (started_at, id)) AS run_stage FROM runs GROUP BY 1)"
_SEGMENT = {"AUTOMOBILE": "active", "BUILDING": "queued", "FURNITURE": "searching", "HOUSEHOLD": "failed", "MACHINERY": "disabled"}
_TOPICS = "topics AS (SELECT c_custkey AS id, lower(replace(c_name, '#', '-')) AS slug, c_name AS name, CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SEGMENT.items()) + " END AS status, TIMESTAMP '2024-01-01' + to_days(CAST(c_custkey % 30 AS INTEGER)) AS created_at FROM customer)"


def topics(spark, d):
    status = F.coalesce(*[F.when(F.col("c_mktsegment") == k, v) for k, v in _SEGMENT.items()])
    day = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(days=(F.col("c_custkey") % 30).cast("int"))
    return T(spark, d, "customer").select(
        F.col("c_custkey").alias("id"), F.lower(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("slug"), F.col("c_name").alias("name"), F.lit("").alias("description"), status.alias("status"),
        day.alias("created_at"), day.alias("updated_at"),
    )


@query(f"WITH {_RUNS}, {_LATEST} SELECT * FROM latest")
def latest_run_per_topic(spark, d):
    return ledger.latest_runs(runs(spark, d))


def results(spark, d):
    return T(spark, d, "events").filter("event_type <> 'signup'").select(F.col("user_id").alias("topic_id"), (F.col("event_type") == "purchase").alias("accepted"))


@query(f"""WITH {_RUNS}, {_LATEST}, {_TOPICS}, c AS (SELECT user_id AS topic_id, count(*) AS n, CAST(sum((event_type = 'purchase')::INT) AS BIGINT) AS a FROM events WHERE event_type <> 'signup' GROUP BY 1)
SELECT id AS topic_id, slug, status, coalesce(n, 0) AS n_results, coalesce(a, 0) AS n_accepted, coalesce(run_status, '') AS run_status, coalesce(run_stage, '') AS run_stage,
  CASE WHEN status = 'searching' AND run_status = 'running' AND run_stage <> '' THEN run_stage ELSE status END AS label, status IN ('queued', 'failed') AS can_process, status = 'searching' AS is_processing
FROM topics LEFT JOIN c ON c.topic_id = id LEFT JOIN latest ON latest.topic_id = id WHERE status <> 'disabled'""")
def topic_index(spark, d):
    return views.topic_index(topics(spark, d), results(spark, d), runs(spark, d)).drop("name", "updated_at")


@query("""SELECT event_id AS id, user_id % 7 AS search_run_id, CASE WHEN user_id % 3 = 0 THEN 'unknown source' ELSE 's' END AS source, CAST(coalesce(CASE WHEN event_type <> 'error' THEN event_id % 101 END, 0) AS INTEGER) AS reviewer_score, CASE WHEN event_type = 'purchase' THEN 'Accepted' ELSE 'Rejected' END AS verdict,
  CAST(row_number() OVER (ORDER BY user_id % 7 DESC, event_type = 'purchase' DESC, coalesce(CASE WHEN event_type <> 'error' THEN event_id % 101 END, 0) DESC, event_id % 10, event_id) AS INTEGER) AS place FROM events WHERE user_id % 5 = 1""")
def topic_evaluations(spark, d):
    e = T(spark, d, "events")
    rows = e.select(
        F.col("event_id").alias("id"), (F.col("user_id") % 5).alias("topic_id"), (F.col("user_id") % 7).alias("search_run_id"), F.lit("t").alias("title"), F.lit("u").alias("url"),
        F.when(F.col("user_id") % 3 == 0, "").otherwise("s").alias("source"), (F.col("event_id") % 10).alias("rank"), F.when(F.col("event_type") != "error", (F.col("event_id") % 101).cast("int")).alias("reviewer_score"),
        F.lit("").alias("page_type"), F.lit("").alias("reviewer_reason"), (F.col("event_type") == "purchase").alias("accepted"),
    )
    order = [-F.col("search_run_id"), ~F.col("accepted"), -F.col("reviewer_score"), "rank", "id"]
    return number_rows(views.evaluations(rows, 1), order, "place").select("id", "search_run_id", "source", "reviewer_score", "verdict", F.col("place").cast("int"))


@query(f"WITH {_TOPICS} SELECT slug, name FROM topics WHERE status = 'active' AND (slug LIKE '%7_%' OR lower(name) LIKE '%7_%')")
def topic_search_like(spark, d):
    return views.search_topics(topics(spark, d), " 7_ ", None)


@query(f"WITH {_TOPICS} SELECT id, slug FROM topics WHERE status = 'active' AND (slug = (SELECT min(slug) FROM topics WHERE status = 'active') OR lower(name) = (SELECT min(slug) FROM topics WHERE status = 'active')) ORDER BY name LIMIT 1")
def topic_exact_lookup(spark, d):
    t = topics(spark, d)
    return views.exact_topic(t, t.filter("status = 'active'").agg(F.min("slug")).first()[0] or "").select("id", "slug")


@query(f"WITH {_TOPICS} SELECT id, slug FROM topics WHERE status = 'queued' ORDER BY created_at, id LIMIT 1")
def queue_head(spark, d):
    return ledger.queue_head(topics(spark, d)).select("id", "slug")


@query(f"WITH {_TOPICS} SELECT id, status FROM topics WHERE status IN ('queued', 'failed')")
def eligible_topics(spark, d):
    return ledger.eligible(topics(spark, d)).select("id", "status")


@query(f"WITH {_RUNS} SELECT CAST(started_at AS DATE) AS day, count(*) AS n_runs, count(*) >= 265 AS reached FROM runs WHERE status IN ('running', 'completed', 'failed') GROUP BY 1")
def daily_cap_by_day(spark, d):
    return ledger.runs_by_day(runs(spark, d), 265)


@query(f"""WITH {_RUNS} SELECT topic_id, CAST(started_at AS DATE) AS day, count(*) FILTER (status = 'running') > 0 OR coalesce(max(started_at) FILTER (status IN ('running', 'completed', 'failed')) + INTERVAL 6 HOUR > CAST(started_at AS DATE) + INTERVAL 24 HOUR, false) AS limited
FROM runs GROUP BY 1, 2""")
def rate_limit_gate(spark, d):
    counted = F.when(F.col("status").isin("running", "completed", "failed"), F.col("started_at"))
    g = runs(spark, d).groupBy("topic_id", F.to_date("started_at").alias("day")).agg(F.count_if(F.col("status") == "running").alias("r"), F.max(counted).alias("m"))
    end = F.col("day").cast("timestamp_ntz") + F.make_dt_interval(days=F.lit(1))
    return g.select("topic_id", "day", ledger.limited(F.col("r"), F.col("m"), end, timedelta(hours=6)).alias("limited"))


@query(f"WITH {_RUNS} SELECT id, CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-01-15 11:30:00' THEN 'failed' ELSE status END AS status, CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-01-15 11:30:00' THEN '' ELSE stage END AS stage, CASE WHEN status = 'running' AND started_at < TIMESTAMP '2024-01-15 11:30:00' THEN '{ledger.STALE_ERROR}' ELSE '' END AS error FROM runs")
def expire_stale_runs(spark, d):
    return ledger.expire_runs(runs(spark, d), NOW).select("id", "status", "stage", "error")


@query(f"WITH {_RUNS}, {_TOPICS} SELECT id, slug FROM topics t WHERE status = 'searching' AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.topic_id = t.id AND r.status = 'running' AND r.started_at >= TIMESTAMP '2024-01-15 11:30:00')")
def orphan_searching_topics(spark, d):
    return ledger.orphans(topics(spark, d), ledger.expire_runs(runs(spark, d), NOW)).select("id", "slug")


_DELTA = "delta AS (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'customer-' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0') ELSE 'new-' || s_suppkey END AS slug, s_name AS name FROM supplier)"


def topic_delta(spark, d):
    s = T(spark, d, "supplier")
    return s.select(F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("customer-"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0"))).otherwise(F.concat(F.lit("new-"), F.col("s_suppkey").cast("string"))).alias("slug"), F.col("s_name").alias("name"))


def half_named(spark, d):
    """Topics of which every other has its slug for a name."""
    return topics(spark, d).withColumn("name", F.when(F.col("id") % 4 == 0, F.col("slug")).otherwise(F.col("name")))


_HALF = f"{_TOPICS}, state AS (SELECT id, slug, CASE WHEN id % 4 = 0 THEN slug ELSE name END AS name, status FROM topics), {_DELTA}, fresh AS (SELECT slug, name, (SELECT max(id) FROM state) + row_number() OVER (ORDER BY slug) AS id FROM delta ANTI JOIN state USING (slug))"


@query(f"WITH {_HALF} SELECT s.id, s.slug, CASE WHEN d.slug IS NOT NULL AND s.name = s.slug THEN d.name ELSE s.name END AS name, s.status FROM state s LEFT JOIN delta d USING (slug) UNION ALL SELECT id, slug, name, 'queued' FROM fresh")
def upsert_topic(spark, d):
    return catalog.ensure_topics(half_named(spark, d), topic_delta(spark, d), NOW).select("id", "slug", "name", "status")


@query(f"WITH {_HALF} SELECT s.id, s.slug, CASE WHEN d.slug IS NOT NULL AND s.name = s.slug THEN d.name ELSE s.name END AS name, CASE WHEN d.slug IS NOT NULL THEN 'searching' ELSE s.status END AS status FROM state s LEFT JOIN delta d USING (slug) UNION ALL SELECT id, slug, name, 'searching' FROM fresh")
def upsert_topic_status(spark, d):
    return catalog.put_topics(half_named(spark, d), topic_delta(spark, d).withColumn("status", F.lit("searching")), NOW).select("id", "slug", "name", "status")


@query(f"WITH {_HALF} SELECT s.id, s.slug, coalesce(d.name, s.name) AS name, CASE WHEN d.slug IS NOT NULL THEN 'd' ELSE '' END AS description, CASE WHEN d.slug IS NOT NULL THEN 'active' ELSE s.status END AS status FROM state s LEFT JOIN delta d USING (slug) UNION ALL SELECT id, slug, name, 'd', 'active' FROM fresh")
def upsert_topic_import(spark, d):
    return catalog.import_topics(half_named(spark, d), topic_delta(spark, d).withColumn("description", F.lit("d")), NOW).select("id", "slug", "name", "description", "status")


def stored_pages(spark, d):
    none = F.lit(None)
    return T(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("topic_id"), F.col("p_name").alias("title"), F.concat(F.lit("https://h.example.com/"), F.col("p_partkey").cast("string")).alias("url"), F.lit("old").alias("source"),
        F.lit(True).alias("official"), none.cast("int").alias("estimated_minutes"), none.cast("string").alias("difficulty"), none.cast("int").alias("evergreen_score"), F.col("p_partkey").cast("int").alias("reading_order"),
        (F.col("p_partkey") % 3 != 0).alias("active"), none.cast("timestamp_ntz").alias("discovered_at"), none.cast("timestamp_ntz").alias("last_verified"), (F.col("p_partkey") % 4).cast("int").alias("verification_failures"),
        F.lit("").alias("last_error"), none.cast("long").alias("search_run_id"), S.at(datetime(2023, 1, 1)).alias("created_at"), S.at(datetime(2023, 1, 1)).alias("updated_at"),
    )


def page_delta(spark, d):
    return T(spark, d, "part").filter("p_partkey % 5 = 0").select(
        F.col("p_size").cast("long").alias("topic_id"), F.concat(F.lit("https://h.example.com/"), (F.col("p_partkey") + F.when(F.col("p_partkey") % 2 == 0, 0).otherwise(1000000)).cast("string")).alias("url"), F.concat(F.lit("new "), F.col("p_name")).alias("title"),
        F.lit("s").alias("source"), F.lit(False).alias("official"), F.lit(5).alias("estimated_minutes"), F.lit("easy").alias("difficulty"), F.lit(50).alias("evergreen_score"), (F.col("p_partkey") + 7).cast("int").alias("reading_order"), F.lit(9).cast("long").alias("search_run_id"),
    )


_STORED = "st AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) AS topic_id, p_name AS title, 'https://h.example.com/' || p_partkey AS url, CAST(p_partkey AS INTEGER) AS reading_order, p_partkey % 3 <> 0 AS active, CAST(p_partkey % 4 AS INTEGER) AS verification_failures FROM part)"
_PDELTA = "de AS (SELECT CAST(p_size AS BIGINT) AS topic_id, 'https://h.example.com/' || (p_partkey + CASE WHEN p_partkey % 2 = 0 THEN 0 ELSE 1000000 END) AS url, 'new ' || p_name AS title, CAST(p_partkey + 7 AS INTEGER) AS reading_order FROM part WHERE p_partkey % 5 = 0)"
_FRESH = "fr AS (SELECT *, (SELECT max(id) FROM st) + row_number() OVER (ORDER BY topic_id, url) AS id FROM de ANTI JOIN st USING (topic_id, url))"


@query(f"WITH {_STORED}, {_PDELTA}, {_FRESH} SELECT st.id, topic_id, coalesce(de.title, st.title) AS title, url, st.reading_order, st.active OR de.title IS NOT NULL AS active, st.verification_failures FROM st LEFT JOIN de USING (topic_id, url) UNION ALL SELECT id, topic_id, title, url, reading_order, true, 0 FROM fr")
def upsert_page_search(spark, d):
    return catalog.put_search_pages(stored_pages(spark, d), page_delta(spark, d), NOW).select("id", "topic_id", "title", "url", "reading_order", "active", "verification_failures")


@query(f"WITH {_STORED}, {_PDELTA}, {_FRESH} SELECT st.id, topic_id, coalesce(de.title, st.title) AS title, url, coalesce(de.reading_order, st.reading_order) AS reading_order, st.active OR de.title IS NOT NULL AS active, CASE WHEN de.title IS NOT NULL THEN 'easy' END AS difficulty FROM st LEFT JOIN de USING (topic_id, url) UNION ALL SELECT id, topic_id, title, url, reading_order, true, 'easy' FROM fr")
def upsert_page_import(spark, d):
    return catalog.put_import_pages(stored_pages(spark, d), page_delta(spark, d), NOW).select("id", "topic_id", "title", "url", "reading_order", "active", "difficulty")


@query(f"WITH {_STORED} SELECT id, topic_id, CAST(-id AS INTEGER) AS reading_order FROM st")
def shift_reading_order(spark, d):
    p = stored_pages(spark, d)
    return catalog.shift_orders(p, p.select("topic_id")).select("id", "topic_id", "reading_order")


@query(f"WITH {_STORED}, {_PDELTA} SELECT id, topic_id, active AND (topic_id NOT IN (SELECT topic_id FROM de) OR de.title IS NOT NULL) AS active FROM st LEFT JOIN de USING (topic_id, url)")
def deactivate_omitted(spark, d):
    return catalog.deactivate_omitted(stored_pages(spark, d), page_delta(spark, d), NOW).select("id", "topic_id", "active")


def stored_results(spark, d):
    none = F.lit(None)
    return stored_pages(spark, d).select(
        "id", "topic_id", F.lit(1).cast("long").alias("search_run_id"), "title", "url", "source", F.lit("").alias("snippet"), F.lit(1).alias("rank"), F.col("id").alias("stored_as_page_id"), "created_at",
        F.lit(80).alias("reviewer_score"), F.lit("guide").alias("page_type"), F.lit("fine").alias("reviewer_reason"), "active",
    ).withColumnRenamed("active", "accepted").withColumn("stored_as_page_id", F.when(F.col("accepted"), F.col("stored_as_page_id")).otherwise(none))


@query(f"WITH {_STORED}, {_PDELTA}, {_FRESH} SELECT st.id, topic_id, coalesce(de.title, st.title) AS title, url, CASE WHEN de.title IS NULL THEN 80 END AS reviewer_score, st.active AND de.title IS NULL AS accepted, CASE WHEN st.active AND de.title IS NULL THEN st.id END AS stored_as_page_id FROM st LEFT JOIN de USING (topic_id, url) UNION ALL SELECT id, topic_id, title, url, NULL, false, NULL FROM fr")
def upsert_candidate(spark, d):
    delta = page_delta(spark, d).select("topic_id", "url", "title", "source", "search_run_id", F.lit("sn").alias("snippet"), F.lit(4).alias("rank"))
    return catalog.put_candidates(stored_results(spark, d), delta, NOW).select("id", "topic_id", "title", "url", "reviewer_score", "accepted", "stored_as_page_id")


@query(f"WITH {_STORED}, {_PDELTA}, {_FRESH} SELECT st.id, topic_id, url, CASE WHEN de.title IS NULL THEN 80 ELSE 33 END AS reviewer_score, CASE WHEN de.title IS NULL THEN st.active ELSE true END AS accepted, CASE WHEN de.title IS NULL THEN 'guide' ELSE 'book' END AS page_type FROM st LEFT JOIN de USING (topic_id, url) UNION ALL SELECT id, topic_id, url, 33, true, 'book' FROM fr")
def upsert_reviewed(spark, d):
    fields = page_delta(spark, d).select("topic_id", "url", "title", "source", "search_run_id", F.lit("sn").alias("snippet"), F.lit(4).alias("rank"), F.lit(1).cast("long").alias("stored_as_page_id"), F.lit(33).alias("reviewer_score"), F.lit("book").alias("page_type"), F.lit("r").alias("reviewer_reason"), F.lit(True).alias("accepted"))
    return catalog.put_reviewed(stored_results(spark, d), fields, NOW).select("id", "topic_id", "url", "reviewer_score", "accepted", "page_type")


def probes(spark, d):
    k = F.col("p_partkey")
    return T(spark, d, "part").select(
        k.alias("page_id"), F.when(k % 6 == 0, 404).when(k % 10 == 0, None).otherwise(200 + k % 5).cast("int").alias("http_status"), F.when(k % 8 == 2, F.concat(F.lit("https://moved.example.com/"), k.cast("string"))).alias("final_url"), F.when(k % 10 == 0, "timeout").alias("error")
    )


_HEALTH = f"""{_STORED}, pr AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN 404 WHEN p_partkey % 10 = 0 THEN NULL ELSE 200 + p_partkey % 5 END AS code, CASE WHEN p_partkey % 8 = 2 THEN 'https://moved.example.com/' || p_partkey END AS final_url, p_partkey % 10 = 0 AS bad FROM part),
h AS (SELECT st.*, pr.id IS NOT NULL AS probed, pr.final_url, coalesce(code BETWEEN 200 AND 399, false) AND NOT coalesce(bad, false) AS good FROM st LEFT JOIN pr USING (id))"""


@query(f"WITH {_HEALTH} SELECT id, CASE WHEN probed AND good THEN coalesce(final_url, url) ELSE url END AS url, CASE WHEN probed AND good THEN 0 WHEN probed THEN verification_failures + 1 ELSE verification_failures END AS verification_failures, active AND NOT (probed AND NOT good AND verification_failures + 1 >= 3) AS active, CASE WHEN probed AND good THEN 'healthy' WHEN probed AND verification_failures + 1 >= 3 THEN 'disabled' WHEN probed THEN 'failed' END AS outcome FROM h")
def link_updates(spark, d):
    return links.apply_probes(stored_pages(spark, d), probes(spark, d), NOW).select("id", "url", "verification_failures", "active", "outcome")


@query(f"WITH {_HEALTH} SELECT count(*) FILTER (probed) AS checked, count(*) FILTER (probed AND good) AS healthy, count(*) FILTER (probed AND NOT good) AS failed, count(*) FILTER (probed AND NOT good AND verification_failures >= 2) AS disabled FROM h")
def link_summary(spark, d):
    return links.summary(links.apply_probes(stored_pages(spark, d), probes(spark, d), NOW))


@query("SELECT p_partkey AS id, 'https://h.example.com/' || p_partkey AS url FROM part WHERE p_partkey % 3 <> 0")
def active_page_scan(spark, d):
    return links.active_pages(stored_pages(spark, d))


def seeds(spark, d):
    p = T(spark, d, "part")
    page = F.struct(
        F.when(F.col("p_partkey") % 97 == 0, " ").otherwise(F.col("p_name")).alias("title"), F.concat(F.when(F.col("p_partkey") % 89 == 0, "ftp://h/").otherwise("https://h/"), F.floor(F.col("p_partkey") / F.when(F.col("p_partkey") % 83 == 0, 0.5).otherwise(1)).cast("string")).alias("url"),
        F.lit("s").alias("source"), F.lit(False).alias("official"), F.when(F.col("p_partkey") % 79 == 0, 0).otherwise(5).alias("estimated_minutes"), F.lit("").alias("difficulty"), F.when(F.col("p_partkey") % 73 == 0, 101).otherwise(7).alias("evergreen_score"),
    )
    order = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", page.alias("page")))), lambda x: x["page"])
    slug = F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))
    return p.groupBy("p_brand").agg(order.alias("pages")).select(F.when(F.col("p_brand").endswith("1"), F.col("p_brand")).otherwise(slug).alias("topic"), F.col("p_brand").alias("name"), F.lit("").alias("description"), "pages")


@query("""WITH p AS (SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS i, p_partkey AS k, CASE WHEN p_partkey % 89 = 0 THEN 'ftp://h/' ELSE 'https://h/' END || CASE WHEN p_partkey % 83 = 0 THEN p_partkey * 2 ELSE p_partkey END AS url FROM part),
q AS (SELECT *, row_number() OVER (PARTITION BY p_brand, url ORDER BY i) > 1 AS dup FROM p),
f AS (SELECT p_brand, i, CASE WHEN k % 97 = 0 THEN 'title is required' WHEN k % 89 = 0 THEN 'url must use http or https' WHEN k % 79 = 0 THEN 'estimated_minutes must be positive' WHEN k % 73 = 0 THEN 'evergreen_score must be between 0 and 100' WHEN dup THEN 'duplicate url' END AS fault FROM q)
SELECT CASE WHEN p_brand LIKE '%1' THEN p_brand ELSE lower(replace(p_brand, '#', '-')) END AS topic, CASE WHEN p_brand LIKE '%1' THEN 'topic must be a lowercase slug' ELSE min_by('page ' || i || ': ' || fault, i) FILTER (fault IS NOT NULL) END AS fault FROM f GROUP BY p_brand""")
def seed_validation_report(spark, d):
    return catalog.seed_faults(seeds(spark, d))


@query("WITH s AS (SELECT CASE WHEN p_brand LIKE '%1' THEN p_brand ELSE lower(replace(p_brand, '#', '-')) END AS topic, CAST(count(*) AS INTEGER) AS n FROM part GROUP BY 1) SELECT row_number() OVER (ORDER BY topic) AS id, topic, 'completed' AS status, n AS pages_found, n AS pages_imported FROM s")
def import_ledger(spark, d):
    empty = spark.createDataFrame([], "id long, topic string, status string, started_at timestamp_ntz, completed_at timestamp_ntz, pages_found int, pages_imported int, error string")
    return catalog.log_import(empty, seeds(spark, d), "completed", "", NOW).select("id", "topic", "status", "pages_found", "pages_imported")


@query("SELECT conv_id, turn, CAST(turn AS INTEGER) AS index, CAST(len(text) % 101 AS INTEGER) AS score, len(text) % 2 = 0 AS should_store FROM conversations")
def decode_review_json(spark, d):
    from ..sources.edges import decode_reviews

    c = T(spark, d, "conversations")
    row = F.struct(F.col("turn").cast("int").alias("index"), (F.length("text") % 101).cast("int").alias("score"), F.lit("guide").alias("page_type"), (F.length("text") % 2 == 0).alias("should_store"), F.col("text").alias("reason"))
    return decode_reviews(c.select("conv_id", "turn", F.to_json(F.struct(F.array(row).alias("results"))).alias("body"))).select("conv_id", "turn", "index", "score", "should_store")


@query("SELECT c_custkey, c_name || ' specific concept tutorial guide deep dive documentation' AS query, CAST(10 AS INTEGER) AS max_results, CAST(8 AS INTEGER) AS n_excluded FROM customer")
def encode_request_json(spark, d):
    from ..sources.edges import encode_requests

    body = encode_requests(T(spark, d, "customer").withColumn("query", S.query_text(F.col("c_name"))))
    back = F.from_json("body", "query string, max_results int, exclude_domains array<string>")
    return body.select("c_custkey", back["query"].alias("query"), back["max_results"].alias("max_results"), F.size(back["exclude_domains"]).alias("n_excluded"))


@query("SELECT DISTINCT p_size AS version, 'size ' || p_size AS name FROM part WHERE p_size NOT IN (SELECT n_nationkey + 1 FROM nation)")
def pending_migrations(spark, d):
    from ..sources.store import pending

    files = T(spark, d, "part").select(F.col("p_size").alias("version"), F.concat(F.lit("size "), "p_size").alias("name")).distinct()
    return pending(files, T(spark, d, "nation").select((F.col("n_nationkey") + 1).alias("version")))


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-z]+://[^/]+(/[^?#]*)', 1), '^/+|/+$', '', 'g') AS t FROM pages), s AS (SELECT page_id, string_split(t, '/') AS x FROM p)
SELECT page_id, len(x) IN (1, 2) AND regexp_matches(x[1], '^[a-z0-9][a-z0-9-]*$') AS ok, CASE WHEN len(x) IN (1, 2) AND regexp_matches(x[1], '^[a-z0-9][a-z0-9-]*$') THEN x[1] END AS topic, CASE WHEN len(x) = 2 AND regexp_matches(x[1], '^[a-z0-9][a-z0-9-]*$') THEN x[2] END AS date FROM s""")
def route_parse(spark, d):
    r = S.reading_path(F.regexp_extract("url", "^[a-z]+://[^/]+(/[^?#]*)", 1))
    return T(spark, d, "pages").select("page_id", r.alias("r")).select("page_id", "r.ok", "r.topic", "r.date")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) END AS day FROM orders")
def strict_epoch_day(spark, d):
    o = T(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-M-d'x'")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return o.select("o_orderkey", S.epoch_day(text).cast("long").alias("day"))


@query(f"WITH {_TOPICS} SELECT coalesce(to_json(list({{'slug': slug, 'name': name}} ORDER BY slug, name)), '[]')::VARCHAR AS body FROM topics WHERE status = 'active' AND slug LIKE '%77%'")
def topics_as_json(spark, d):
    return views.as_json(views.search_topics(topics(spark, d), "77", None))


_FULL_RUNS = """fr AS (SELECT event_id AS id, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'completed' WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' ELSE 'rate_limited' END AS status,
  CASE WHEN event_id % 3 = 0 THEN 'reviewing' ELSE '' END AS stage FROM events)"""


def full_runs(spark, d):
    r = runs(spark, d)
    none = {"provider": "", "query": "", "reviewer_model": ""} | dict.fromkeys(["result_count", "stored_count", "reviewer_input_tokens", "reviewer_output_tokens", "reviewer_total_tokens"], 0)
    for name, value in none.items():
        r = r.withColumn(name, F.lit(value))
    return r.select(*spark.createDataFrame([], RUNS).columns)


@query(f"""WITH {_FULL_RUNS}, top AS (SELECT max(id) AS top FROM fr)
SELECT id, status, stage, 0 AS result_count, 0 AS stored_count, '' AS reviewer_model, 0 AS reviewer_total_tokens, '' AS error FROM fr
UNION ALL SELECT top + 1, 'completed', '', 9, 4, 'm', 30, '' FROM top UNION ALL SELECT top + 2, 'failed', '', 0, 0, '', 0, 'no answer' FROM top
UNION ALL SELECT top + 3, 'running', 'storing', 0, 0, '', 0, '' FROM top UNION ALL SELECT top + 4, 'rate_limited', '', 0, 0, '', 0, '' FROM top""")
def run_lifecycle(spark, d):
    """Four runs after those of the ledger: one completes, one fails, one comes to storing, one is refused."""
    r = full_runs(spark, d)
    top = r.agg(F.max("id")).first()[0]
    for i, status in enumerate(["running", "running", "running", "rate_limited"]):
        r = ledger.insert_run(r, top + 1 + i, 1, "search", "q", status, NOW, "searching" if status == "running" else "")
    r = ledger.set_stage(ledger.fail_run(ledger.complete_run(r, top + 1, 9, 4, NOW, "m", (10, 20, 30)), top + 2, "no answer", NOW), top + 3, "storing")
    return r.select("id", "status", "stage", "result_count", "stored_count", "reviewer_model", "reviewer_total_tokens", "error")


@query(f"""WITH {_RUNS}, {_LATEST}, {_TOPICS} SELECT slug, name, status, CASE WHEN status = 'searching' AND run_status = 'running' AND run_stage <> '' THEN run_stage ELSE status END AS label, status IN ('queued', 'failed') AS can_process
FROM topics LEFT JOIN latest ON latest.topic_id = id WHERE status <> 'disabled'""")
def topic_status(spark, d):
    return views.topic_status(topics(spark, d), runs(spark, d))


@query(f"WITH {_TOPICS} SELECT id AS topic_id, name, updated_at, CAST(row_number() OVER (ORDER BY updated_at DESC, name, slug) AS INTEGER) AS place FROM (SELECT *, created_at AS updated_at FROM topics) WHERE status <> 'disabled'")
def topic_index_order(spark, d):
    rows = views.topic_index(topics(spark, d), results(spark, d), runs(spark, d))
    placed = number_rows(rows, [-F.unix_micros(F.col("updated_at").cast("timestamp")), "name", "slug"], "place")
    return placed.select("topic_id", "name", "updated_at", F.col("place").cast("int"))


@query(f"""WITH {_RUNS}, {_LATEST}, {_TOPICS}, own AS (SELECT * FROM topics WHERE slug = (SELECT min(slug) FROM topics WHERE status = 'searching'))
SELECT slug, name, status, CASE WHEN run_status = 'running' AND run_stage <> '' THEN run_stage ELSE status END AS label, (SELECT count(*) FROM events WHERE user_id = own.id AND event_type <> 'signup') AS n_evaluated,
  (SELECT count(*) FROM events WHERE user_id = own.id AND event_type = 'purchase') AS n_accepted FROM own LEFT JOIN latest ON latest.topic_id = own.id""")
def evaluations_header(spark, d):
    """Of the first topic that is searched."""
    t = topics(spark, d)
    e = T(spark, d, "events").filter("event_type <> 'signup'").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("topic_id"), F.lit(1).cast("long").alias("search_run_id"), F.lit("t").alias("title"), F.lit("u").alias("url"), F.lit("s").alias("source"),
        F.lit(1).alias("rank"), F.lit(50).alias("reviewer_score"), F.lit("").alias("page_type"), F.lit("").alias("reviewer_reason"), (F.col("event_type") == "purchase").alias("accepted"),
    )
    return views.evaluations_of(t, e, runs(spark, d), t.filter("status = 'searching'").agg(F.min("slug")).first()[0] or "")[0]


@query(f"WITH {_VERDICTS}, c AS (SELECT *, accepted AND sum(accepted::INT) OVER (PARTITION BY topic ORDER BY review_order) <= 5 AS kept FROM o) SELECT doc_id, topic, kept AS accepted, CAST(row_number() OVER (PARTITION BY topic ORDER BY review_order) AS INTEGER) AS rank FROM c")
def final_ranks(spark, d):
    return review.final_ranks(review.capped(verdicts(spark, d), 5)).select("doc_id", "topic", "accepted", "rank")


@query(f"WITH {_VERDICTS} SELECT doc_id, topic, accepted FROM o")
def cap_below_one(spark, d):
    """A cap below one caps nothing."""
    return review.capped(verdicts(spark, d), 0).select("doc_id", "topic", "accepted")


@query(f"WITH {_RANKED} SELECT topic, candidate_index AS index, title, url, host AS source, rank, least(strlen(snippet), 700) - strlen(snippet) <= 0 AS fits FROM ranked")
def review_requests(spark, d):
    rows = candidates.normalize_results(page_results(spark, d), BLOCKED).withColumn("source", F.col("host"))
    return review.requests(rows).select("topic", "index", "title", "url", "source", "rank", (F.octet_length("snippet") <= 702).alias("fits"))


@query(f"WITH {_TOPICS} SELECT slug, name FROM topics WHERE status = 'active' AND (slug LIKE '%1%' OR lower(name) LIKE '%1%') ORDER BY name, slug LIMIT 10")
def topic_search_first(spark, d):
    return views.search_topics(topics(spark, d), "1")


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS shown FROM part")
def blank_as_null(spark, d):
    p = T(spark, d, "part")
    return p.select("p_partkey", S.null_if_blank(F.when(F.col("p_partkey") % 3 == 0, " \u00a0\n").otherwise(F.concat(F.lit(" "), "p_name"))).alias("shown"))


@query("SELECT o_orderkey, strftime(o_orderdate + to_seconds(o_orderkey % 86400), '%Y-%m-%d %H:%M:%S') AS shown, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + to_seconds(o_orderkey % 86400) END AS back, CAST(CAST(o_orderdate + to_seconds(o_orderkey % 86400) AS DATE) AS TIMESTAMP) AS day FROM orders")
def time_format(spark, d):
    t = F.col("o_orderdate") + F.make_dt_interval(secs=(F.col("o_orderkey") % 86400).cast("decimal(18,6)"))
    shown = S.format_time(t)
    return T(spark, d, "orders").select("o_orderkey", shown.alias("shown"), S.parse_time(F.when(F.col("o_orderkey") % 2 == 0, shown).otherwise(F.concat(shown, F.lit("Z")))).alias("back"), S.day_start(t).alias("day"))


@query(f"WITH {_TOPICS} SELECT id, CASE WHEN id % 3 > 0 THEN slug END AS found FROM topics")
def view_paths(spark, d):
    t = topics(spark, d)
    path = F.concat(F.lit("/topics/"), "slug", F.when(F.col("id") % 3 == 0, "/other").when(F.col("id") % 3 == 1, "/status").otherwise("/status/"))
    return t.select("id", S.topic_path(path, "status").alias("found"))


@query(f"""WITH {_TOPICS}, gone AS (SELECT id FROM topics WHERE status = 'disabled'), {_STORED}
SELECT 'topics' AS name, count(*) AS n FROM topics WHERE id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'pages', count(*) FROM st WHERE topic_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'topic_search_runs', count(*) FROM events WHERE user_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'daily_readings', count(*) FROM orders WHERE o_custkey NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'topic_search_results', count(*) FROM st WHERE topic_id NOT IN (SELECT id FROM gone) UNION ALL SELECT 'stored', count(*) FROM st WHERE active AND topic_id NOT IN (SELECT id FROM gone)""")
def cascade_delete(spark, d):
    t = topics(spark, d)
    tables = {"topics": t, "pages": stored_pages(spark, d), "topic_search_runs": full_runs(spark, d), "daily_readings": assignments(spark, d), "topic_search_results": stored_results(spark, d)}
    after = catalog.delete_topics(tables, t.filter("status = 'disabled'"))
    counts = [df.agg(F.lit(n).alias("name"), F.count("*").alias("n")) for n, df in after.items()]
    counts.append(after["topic_search_results"].agg(F.lit("stored").alias("name"), F.count("stored_as_page_id").alias("n")))
    return reduce(DataFrame.unionByName, counts)


@query("""WITH p AS (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages)
SELECT page_id, 0 AS position, title, url, 'snip' AS snippet, (page_id % 100) / 100.0::DOUBLE AS provider_score FROM p UNION ALL SELECT page_id, 1, title || '2', url || '/2', '', 0.5 FROM p""")
def decode_search_json(spark, d):
    from ..sources.edges import decode_results

    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    row = lambda t, u, c, s: F.struct(t.alias("title"), u.alias("url"), F.lit(c).alias("content"), s.alias("score"))
    both = F.array(row(title, F.col("url"), "snip", F.pmod("page_id", F.lit(100)) / 100.0), row(F.concat(title, F.lit("2")), F.concat("url", F.lit("/2")), "", F.lit(0.5).cast("double")))
    return decode_results(T(spark, d, "pages").select("page_id", F.to_json(F.struct(both.alias("results"))).alias("body")))


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN trim(text, e' ') ELSE trim('(' || text || ')', ' ') END AS text FROM conversations")
def review_answer_text(spark, d):
    """An answer's text stands in output_text, or else in parts."""
    from ..sources.edges import answer_text

    c = T(spark, d, "conversations")
    part = lambda x: F.struct(F.array(F.struct(x.alias("text"))).alias("content"))
    nested = F.array(part(F.lit("(")), part(F.col("text")), part(F.lit(")")))
    body = F.to_json(F.struct(F.when(F.col("turn") % 2 == 0, F.col("text")).otherwise(" ").alias("output_text"), nested.alias("output")))
    return answer_text(c.select("conv_id", "turn", body.alias("body"))).select("conv_id", "turn", "text")


@query(f"""WITH {_TOPICS}, {_STORED}, w AS (SELECT 'customer-' || lpad(CAST(p_size AS VARCHAR), 9, '0') AS slug, p_name AS title, DATE '1997-01-01' + CAST(p_partkey % 700 AS INTEGER) AS reading_date FROM part),
m AS (SELECT t.id AS topic_id, reading_date, min(st.id) AS page_id FROM w JOIN topics t USING (slug) JOIN st ON st.topic_id = t.id AND st.title = w.title GROUP BY 1, 2), o AS (SELECT o_orderkey AS id, o_custkey AS topic_id, CAST(o_orderdate AS DATE) AS reading_date, o_orderkey % 200 + 1 AS page_id FROM orders)
SELECT * FROM o UNION ALL SELECT (SELECT max(id) FROM o) + row_number() OVER (ORDER BY topic_id, reading_date), topic_id, reading_date, page_id FROM m ANTI JOIN o USING (topic_id, reading_date)""")
def assign_titled(spark, d):
    """Every page is asked for by its topic's slug and its title."""
    slug = F.concat(F.lit("customer-"), F.lpad(F.col("p_size").cast("string"), 9, "0"))
    day = F.date_add(F.lit("1997-01-01").cast("date"), (F.col("p_partkey") % 700).cast("int"))
    wanted = T(spark, d, "part").select(slug.alias("slug"), F.col("p_name").alias("title"), day.alias("reading_date"))
    return rotation.assign_titled(assignments(spark, d), wanted, topics(spark, d), stored_pages(spark, d), NOW).select("id", "topic_id", "reading_date", "page_id")


_HTML = "replace(replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(34), '&#34;'), chr(39), '&#39;'), '+', '&#43;')"


@query(f"SELECT page_id, '<tr><td>' || page_id || '</td><td>' || {_HTML.format('url')} || '</td><td>' || {_HTML.format('html')} || '</td></tr>' AS html FROM pages")
def page_rows_html(spark, d):
    """Every page's markup, shown as text."""
    return views.html_rows(T(spark, d, "pages").withColumnRenamed("html", "source"), ["page_id", "url", "source"]).select("page_id", "html")


@query(f"""WITH {_TOPICS}, s AS (SELECT slug, name FROM topics WHERE status = 'active' ORDER BY name, slug LIMIT 10)
SELECT '<!doctype html><html><head><meta charset="utf-8"><title>Topics &amp; names</title></head><body><h1>Topics &amp; names</h1><table>' || string_agg('<tr><td>' || slug || '</td><td>' || name || '</td></tr>', '' ORDER BY slug, name) || '</table></body></html>' AS body FROM s""")
def topics_as_html(spark, d):
    """The page of the first ten topics."""
    return views.as_html(views.search_topics(topics(spark, d)), "Topics & names", ["slug", "name"])
