"""The operators that work on whole ledgers and queues, bound to the test tables, each with its SQL.

Roles as in `bindings`; a queued topic's candidates are the parts with its key's last two digits.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import admission, candidates, catalog, constraints, ledger, links, review
from ..schemas import IMPORTS, PAGES, PROBES, RESULTS, REVIEWS, RUNS, Options
from ..numbering import shared_path
from ..sources import buckets
from ..sources.edges import encode_requests
from ..sources.search_source import ROWS
from . import bindings as B
from .bindings import ORACLES, QUERIES, T, query  # noqa: F401  the queries here join those of bindings
from .queue import process_queue as searched_queue
from .search import State

# ---- C7: the least interval, replayed over the ledger


def _replay_sql(by: str, interval: str) -> str:
    """One by one: the next admitted time is the first no sooner than the interval after the last."""
    return f"""WITH RECURSIVE t AS (SELECT {by} AS k, ts, min(event_id) AS id FROM events GROUP BY 1, 2),
hop AS (SELECT k, ts, min(ts) OVER (PARTITION BY k ORDER BY ts RANGE BETWEEN INTERVAL {interval} FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM t),
chain AS (SELECT k, min(ts) AS ts FROM t GROUP BY k UNION ALL SELECT hop.k, hop.later FROM chain JOIN hop ON chain.k = hop.k AND chain.ts = hop.ts WHERE hop.later IS NOT NULL)
SELECT e.event_id AS id, e.ts AS started_at, h.id IS NOT NULL AS admitted FROM events e LEFT JOIN (SELECT t.id FROM t JOIN chain c ON t.k = c.k AND t.ts = c.ts) h ON h.id = e.event_id"""


def _requests(spark, d) -> DataFrame:
    return T(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"), "user_id")


@query(_replay_sql("0", "30 MINUTE"))
def ledger_replay(spark, d):
    return admission.replay(_requests(spark, d), timedelta(minutes=30)).drop("user_id")


@query(_replay_sql("user_id", "8 HOUR"))
def ledger_replay_by_topic(spark, d):
    return admission.replay(_requests(spark, d), timedelta(hours=8), ["user_id"]).drop("user_id")


# ---- C6: a day's cap over a queue


@query(f"""WITH {B._RUNS}, {B._TOPICS}, used AS (SELECT CAST(started_at AS DATE) AS day, count(*) AS n FROM runs WHERE status IN ('running', 'completed', 'failed') GROUP BY 1)
SELECT id, CAST(created_at AS DATE) AS day, CAST(row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at, id) AS INTEGER) AS place,
  row_number() OVER (PARTITION BY CAST(created_at AS DATE) ORDER BY created_at, id) <= (SELECT CAST(avg(n) AS BIGINT) + 2 FROM used) - coalesce(used.n, 0) AS admitted
FROM topics LEFT JOIN used ON used.day = CAST(created_at AS DATE) WHERE status = 'queued'""")
def queue_admission(spark, d):
    used = ledger.runs_by_day(B.runs(spark, d))
    cap = used.agg(F.floor(F.avg("n_runs") + 0.5) + 2).first()[0]
    queue = B.topics(spark, d).filter("status = 'queued'").select("id", "created_at", F.to_date("created_at").alias("day"))
    return admission.admitted(queue, used, cap, ["day"], ["created_at", "id"]).drop("created_at")


# ---- D17: chains, cycles and contests of moved URLs

_MOVES = """pages AS (SELECT p_partkey AS id, p_size AS topic_id, 'u' || p_partkey AS url, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS n FROM part),
near AS (SELECT *, lag(url) OVER w AS prev, lead(url) OVER w AS next, lag(url, 2) OVER w AS prev2, lag(url, 3) OVER w AS prev3 FROM pages WINDOW w AS (PARTITION BY topic_id ORDER BY id)),
wanted AS (SELECT id, topic_id, url, CASE
  WHEN n % 12 = 0 THEN CASE WHEN n % 24 = 0 THEN 'new' || id END WHEN n % 12 <= 5 THEN prev WHEN n % 12 = 6 THEN next WHEN n % 12 = 7 THEN prev
  WHEN n % 12 <= 9 THEN 'both' || CAST(n // 12 AS INTEGER) WHEN n % 12 = 10 THEN prev2 ELSE prev3 END AS final_url FROM near)"""


@query(f"""WITH RECURSIVE {_MOVES},
asked AS (SELECT w.id, w.topic_id, w.final_url, h.id AS holder FROM wanted w LEFT JOIN pages h ON h.topic_id = w.topic_id AND h.url = w.final_url WHERE w.final_url <> w.url),
chance AS (SELECT topic_id, final_url, min(id) AS id, any_value(holder) AS holder FROM asked WHERE holder IS NULL OR id > holder GROUP BY 1, 2),
got AS (SELECT id FROM chance WHERE holder IS NULL UNION ALL SELECT c.id FROM chance c JOIN got ON c.holder = got.id)
SELECT w.id, CASE WHEN got.id IS NOT NULL THEN w.final_url ELSE w.url END AS url, CASE WHEN w.final_url <> w.url AND got.id IS NULL THEN 'conflict' ELSE 'healthy' END AS outcome FROM wanted w LEFT JOIN got ON got.id = w.id""")
def link_moves(spark, d):
    w = Window.partitionBy("topic_id").orderBy("id")
    p = T(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("long").alias("topic_id"), F.concat(F.lit("u"), F.col("p_partkey").cast("string")).alias("url"))
    n = F.row_number().over(w)
    near = p.withColumn("n", n).withColumn("prev", F.lag("url").over(w)).withColumn("next", F.lead("url").over(w)).withColumn("prev2", F.lag("url", 2).over(w)).withColumn("prev3", F.lag("url", 3).over(w))
    k = F.col("n") % 12
    to = (
        F.when(k == 0, F.when(F.col("n") % 24 == 0, F.concat(F.lit("new"), "id"))).when(k <= 5, F.col("prev")).when(k == 6, F.col("next")).when(k == 7, F.col("prev"))
        .when(k <= 9, F.concat(F.lit("both"), F.floor(F.col("n") / 12).cast("string"))).when(k == 10, F.col("prev2")).otherwise(F.col("prev3"))
    )
    probes = near.select(F.col("id").alias("page_id"), F.lit(200).alias("http_status"), to.alias("final_url"), F.lit("").alias("error"))
    kinds = {"active": F.lit(True), "verification_failures": F.lit(0), "last_error": F.lit(""), "last_verified": F.lit(None).cast("timestamp_ntz")}
    pages = p.select("*", *[c.alias(n) for n, c in kinds.items()])
    return links.apply_probes(pages, probes.select(*[f.split()[0] for f in PROBES.split(", ")]), B.NOW).select("id", "url", "outcome")


# ---- C4: the whole queue

LATER = datetime(2024, 3, 1, 12)
MOST = 1000
_FOUND = f"""{B._TOPICS},
q AS (SELECT id AS topic_id, slug AS topic, row_number() OVER (ORDER BY created_at, id) AS place FROM topics WHERE status = 'queued' QUALIFY place <= {MOST}),
found AS (SELECT q.*, CAST(p_partkey // 100 AS INTEGER) AS position, p_name AS title, 'https://docs.example.org/guide/p' || (p_partkey // 100 - CASE WHEN p_partkey // 100 % 5 = 4 THEN 1 ELSE 0 END) AS url, p_type AS snippet, (p_size % 10) / 10.0::DOUBLE AS provider_score, 'docs.example.org' AS host
  FROM q JOIN part ON p_partkey % 100 = topic_id % 100 WHERE topic_id % 17 <> 0 AND topic_id % 19 <> 0),
firsts AS (SELECT * FROM found QUALIFY row_number() OVER (PARTITION BY topic_id, url ORDER BY position) = 1),
scored AS (SELECT *, {B._SCORE} AS own_score, CAST(position + 1 AS INTEGER) AS first_rank FROM firsts),
ranked AS (SELECT *, row_number() OVER (PARTITION BY topic_id ORDER BY own_score DESC, first_rank) AS index FROM scored),
judged AS (SELECT *, (index * 37) % 101 AS score, CASE WHEN index % 7 = 0 THEN 'listicle' ELSE 'guide' END AS kind FROM ranked WHERE topic_id % 23 <> 0),
gated AS (SELECT *, index % 5 <> 0 AND score >= 65 AND kind <> 'listicle' AS good FROM judged),
ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY topic_id ORDER BY good DESC, score DESC, first_rank) AS INTEGER) AS rank FROM gated),
capped AS (SELECT *, good AND rank <= 10 AS accepted FROM ordered),
stored AS (SELECT topic_id, url, CAST(row_number() OVER (ORDER BY place, topic_id, url) AS BIGINT) AS id FROM capped WHERE accepted)"""


def _queue(spark, d):
    """The state after the queue, and what became of its topics."""

    class Provider:
        def search_all(self, queries, most):
            own = F.broadcast(queries.withColumnRenamed("topic_id", "_k"))
            bad, none = F.col("_k") % 17 == 0, F.col("_k") % 19 == 0
            # a small file that becomes many rows: dealt to all cores first
            part = T(spark, d, "part").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
            place = F.floor(F.col("p_partkey") / 100).cast("int")
            url = F.concat(F.lit("https://docs.example.org/guide/p"), (place - F.when(place % 5 == 4, 1).otherwise(0)).cast("string"))
            hits = own.filter(~bad & ~none).join(part, F.col("_k") % 100 == F.col("p_partkey") % 100).select("topic", "query", place.alias("position"), F.col("p_name").alias("title"), url.alias("url"), F.col("p_type").alias("snippet"), ((F.col("p_size") % 10) / 10.0).alias("provider_score"), F.lit(1).alias("attempts"), F.lit("").alias("error"))
            lost = own.filter(bad | none).select("topic", "query", *[F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in ROWS.split(", ")[2:7])], F.lit(1).alias("attempts"), F.when(bad, "no answer").otherwise("").alias("error"))
            return hits.unionByName(lost)

    class Reviewer:
        def review_all(self, asked):
            own = asked.withColumnRenamed("topic_id", "_k")
            made = {"review_position": F.col("index"), "score": (F.col("index") * 37) % 101, "page_type": F.when(F.col("index") % 7 == 0, "listicle").otherwise("guide"), "should_store": F.col("index") % 5 != 0, "reason": F.lit("ok")}
            given = own.filter("_k % 23 <> 0").select(*[made.get(f.split()[0], F.col(f.split()[0])).alias(f.split()[0]) for f in REVIEWS.split(", ")])
            told = own.groupBy("topic", "_k").agg(F.count("*").alias("n")).select("topic", F.lit("m").alias("model"), F.col("n").cast("int").alias("input_tokens"), F.lit(1).alias("output_tokens"), (F.col("n") + 1).cast("int").alias("total_tokens"), F.when(F.col("_k") % 23 == 0, "refused").otherwise("").alias("error"))
            return given, told

    empty = lambda s: spark.createDataFrame([], s)
    past = B.runs(spark, d)
    kinds = dict(f.split() for f in RUNS.split(", "))
    full = past.select(*[F.col(c) if c in past.columns else F.lit("" if t == "string" else 0).cast(t).alias(c) for c, t in kinds.items()])
    state = State(B.topics(spark, d), empty(PAGES), full, empty(RESULTS))
    after, outcome, error = searched_queue(state, Provider(), Reviewer(), LATER, Options(daily_limit=MOST, min_interval=timedelta(0)), most=MOST)
    if error:
        raise error
    return after, outcome


@query(f"""WITH {_FOUND}, sums AS (SELECT topic_id, count(*) AS total, count(*) FILTER (accepted) AS stored FROM capped GROUP BY 1)
SELECT q.topic_id, CAST(q.place AS INTEGER) AS place, CAST((SELECT max(event_id) FROM events) + q.place AS BIGINT) AS run_id, CASE WHEN coalesce(stored, 0) > 0 THEN 'completed' ELSE 'failed' END AS status,
  CAST(CASE WHEN stored > 0 THEN total ELSE 0 END AS BIGINT) AS total, CAST(coalesce(stored, 0) AS BIGINT) AS stored,
  CASE WHEN q.topic_id % 17 = 0 THEN 'no answer' WHEN q.topic_id % 19 = 0 THEN q.topic WHEN q.topic_id % 23 = 0 THEN 'refused' WHEN coalesce(stored, 0) = 0 THEN q.topic ELSE '' END AS error,
  CASE WHEN coalesce(stored, 0) > 0 THEN 'active' ELSE 'failed' END AS topic_status
FROM q LEFT JOIN sums USING (topic_id)""")
def process_queue(spark, d):
    after, outcome = _queue(spark, d)
    now = after.topics.select(F.col("id").alias("topic_id"), F.col("status").alias("topic_status"))
    return outcome.join(now, "topic_id").select("topic_id", "place", "run_id", "status", F.col("total").cast("long").alias("total"), F.col("stored").cast("long").alias("stored"), "error", "topic_status")


@query(f"""WITH {_FOUND}
SELECT r.topic_id, r.url, coalesce(c.rank, r.first_rank) AS rank, CAST(c.score AS INTEGER) AS reviewer_score, coalesce(c.kind, '') AS page_type, coalesce(c.accepted, false) AS accepted, s.id AS stored_as_page_id,
  CAST(CASE WHEN c.accepted THEN c.rank END AS INTEGER) AS reading_order
FROM ranked r LEFT JOIN capped c USING (topic_id, url) LEFT JOIN stored s ON s.topic_id = r.topic_id AND s.url = r.url""")
def process_queue_results(spark, d):
    after, _ = _queue(spark, d)
    pages = after.pages.select(F.col("id").alias("stored_as_page_id"), "reading_order")
    return after.results.join(pages, "stored_as_page_id", "left").select("topic_id", "url", "rank", "reviewer_score", "page_type", "accepted", "stored_as_page_id", "reading_order")


# ---- C9: an import from end to end, over a catalog that lacks some of it and has more


_IMPORT = """old AS (SELECT p_partkey AS id, p_size AS topic_id, 'https://h/' || p_partkey AS url, p_partkey % 3 <> 0 AS active FROM part WHERE p_partkey % 4 <> 3),
seed AS (SELECT p_partkey, p_size AS topic_id, 'https://h/' || p_partkey AS url, p_name AS title, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) AS INTEGER) AS place FROM part WHERE p_partkey % 4 <> 0 AND p_size % 2 = 0)"""


@query(f"""WITH {_IMPORT}
SELECT old.id, old.topic_id, old.url, coalesce(seed.title, 'old') AS title, CASE WHEN seed.url IS NOT NULL THEN true WHEN old.topic_id % 2 = 0 THEN false ELSE old.active END AS active,
  CAST(CASE WHEN seed.url IS NOT NULL THEN seed.place WHEN old.topic_id % 2 = 0 THEN -old.id ELSE 7 END AS INTEGER) AS reading_order FROM old LEFT JOIN seed USING (topic_id, url)
UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY topic_id, url), topic_id, url, title, true, place FROM seed WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.topic_id = seed.topic_id AND old.url = seed.url)""")
def import_pages(spark, d):
    """Every second size imports its parts: shifted, overwritten, added, and what is omitted deactivated."""
    part = T(spark, d, "part")
    url = F.concat(F.lit("https://h/"), F.col("p_partkey").cast("string"))
    have = {"id": F.col("p_partkey"), "topic_id": F.col("p_size"), "title": F.lit("old"), "url": url, "reading_order": F.lit(7), "active": F.col("p_partkey") % 3 != 0}
    pages = part.filter("p_partkey % 4 <> 3").select(*[have.get(n, F.lit(None)).cast(t).alias(n) for n, t in (f.split() for f in PAGES.split(", "))])
    page = F.struct(F.col("p_name").alias("title"), url.alias("url"), F.lit("s").alias("source"), F.lit(False).alias("official"), F.lit(None).cast("int").alias("estimated_minutes"), F.lit(None).cast("string").alias("difficulty"), F.lit(None).cast("int").alias("evergreen_score"))
    wanted = part.filter("p_partkey % 4 <> 0 AND p_size % 2 = 0").groupBy("p_size").agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), page.alias("page")))).alias("p"))
    seeds = wanted.select(F.concat(F.lit("size-"), F.col("p_size").cast("string")).alias("topic"), F.lit("n").alias("name"), F.lit("").alias("description"), F.col("p")["page"].alias("pages"))
    topics = part.select("p_size").distinct().select(F.col("p_size").cast("long").alias("id"), F.concat(F.lit("size-"), F.col("p_size").cast("string")).alias("slug"), F.lit("n").alias("name"), F.lit("").alias("description"), F.lit("active").alias("status"), S.at(B.NOW).alias("created_at"), S.at(B.NOW).alias("updated_at"))
    _, after, _ = catalog.import_seed(topics, pages, spark.createDataFrame([], IMPORTS), seeds, B.NOW)
    return after.select("id", "topic_id", "url", "title", "active", "reading_order")


# ---- S4a, S5: every field of a request


@query("""SELECT c_custkey, c_name || ' specific concept tutorial guide deep dive documentation' AS query, 'basic' AS search_depth, 'general' AS topic, false AS include_answer, false AS include_raw_content, false AS include_images, false AS include_favicon, true AS include_usage,
  CAST(10 AS INTEGER) AS max_results, 'facebook.com,github.com,instagram.com,news.ycombinator.com,reddit.com,stackoverflow.com,w3schools.com,youtube.com' AS exclude_domains FROM customer""")
def encode_request_fields(spark, d):
    body = encode_requests(T(spark, d, "customer").withColumn("query", S.query_text(F.col("c_name"))))
    flags = ["include_answer", "include_raw_content", "include_images", "include_favicon", "include_usage"]
    back = F.from_json("body", "query string, search_depth string, topic string, max_results int, exclude_domains array<string>, " + ", ".join(f"{f} boolean" for f in flags))
    return body.select("c_custkey", *[back[n].alias(n) for n in ("query", "search_depth", "topic", *flags, "max_results")], F.array_join(back["exclude_domains"], ",").alias("exclude_domains"))


@query(f"""WITH {B._RANKED}, k AS (SELECT *, list_max(list_filter(range(0, 701), lambda n: strlen(left(snippet, n)) <= 700)) AS k FROM ranked),
c AS (SELECT *, left(snippet, k) || CASE WHEN length(snippet) > k AND strlen(left(snippet, k)) < 700 THEN chr(65533) ELSE '' END AS cut FROM k)
SELECT topic, candidate_index AS index, title, url, host AS source, rank, {B._STRIP('cut')} AS snippet FROM c""")
def review_request_texts(spark, d):
    rows = candidates.normalize_results(B.page_results(spark, d), B.BLOCKED).withColumn("source", F.col("host"))
    return review.requests(rows).select("topic", "index", "title", "url", "source", "rank", "snippet")


# ---- the declared rules, over tables with faults


def _faulty(spark, d) -> dict[str, DataFrame]:
    now = S.at(B.NOW)
    fill = lambda df, schema: df.select(*[F.col(n) if n in df.columns else (now if t == "timestamp_ntz" else F.lit({"string": "x", "boolean": True}.get(t, 0)).cast(t)).alias(n) for n, t in (f.split() for f in schema.split(", "))])
    k, o = F.col("p_partkey"), F.col("o_orderkey")
    t = B.topics(spark, d).withColumn("status", F.when(F.col("id") % 50 == 0, "asleep").otherwise(F.col("status"))).withColumn("name", F.when(F.col("id") % 40 != 0, F.col("name")))
    pages = T(spark, d, "part").select(k.alias("id"), F.when(k % 30 != 0, F.col("p_size").cast("long")).alias("topic_id"), F.concat(F.lit("u"), F.floor(k / 2).cast("string")).alias("url"), k.cast("int").alias("reading_order"))
    reads = T(spark, d, "orders").select(o.alias("id"), F.col("o_custkey").alias("topic_id"), F.to_date("o_orderdate").alias("reading_date"), (F.pmod(o, F.lit(250)) * 9 + 1).alias("page_id"))
    return {"topics": t, "pages": fill(pages, PAGES), "daily_readings": reads.withColumn("created_at", now)}


_FAULTY = f"""{B._TOPICS}, t AS (SELECT id, slug, CASE WHEN id % 40 <> 0 THEN name END AS name, CASE WHEN id % 50 = 0 THEN 'asleep' ELSE status END AS status FROM topics),
p AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 30 <> 0 THEN p_size END AS topic_id, 'u' || (p_partkey // 2) AS url FROM part),
r AS (SELECT o_orderkey AS id, o_custkey AS topic_id, CAST(o_orderdate AS DATE) AS reading_date, (o_orderkey % 250) * 9 + 1 AS page_id FROM orders)"""


@query(f"""WITH {_FAULTY}
SELECT 'topics' AS "table", 'name is required' AS rule, CAST(id AS VARCHAR) AS key, CAST(1 AS BIGINT) AS n FROM t WHERE name IS NULL
UNION ALL SELECT 'topics', 'status is none of the allowed', CAST(id AS VARCHAR), 1 FROM t WHERE status = 'asleep'
UNION ALL SELECT 'pages', 'topic_id is required', CAST(id AS VARCHAR), 1 FROM p WHERE topic_id IS NULL
UNION ALL SELECT 'pages', 'topic_id, url is a key', topic_id || ',' || url, count(*) FROM p WHERE topic_id IS NOT NULL GROUP BY topic_id, url HAVING count(*) > 1
UNION ALL SELECT 'daily_readings', 'topic_id, reading_date is a key', topic_id || ',' || reading_date, count(*) FROM r GROUP BY topic_id, reading_date HAVING count(*) > 1
UNION ALL SELECT 'daily_readings', 'page_id refers to pages', CAST(page_id AS VARCHAR), count(*) FROM r WHERE page_id NOT IN (SELECT id FROM p) GROUP BY page_id
UNION ALL SELECT 'pages', 'topic_id refers to topics', CAST(topic_id AS VARCHAR), count(*) FROM p WHERE topic_id NOT IN (SELECT id FROM t) GROUP BY topic_id""")
def constraint_violations(spark, d):
    return constraints.violations(_faulty(spark, d))


@query(f"""WITH {_FAULTY}, gone_t AS (SELECT id FROM t WHERE id % 7 = 0), gone_p AS (SELECT id FROM p WHERE topic_id IN (SELECT id FROM gone_t))
SELECT 'daily_readings' AS "table", id, 'page_id' AS "column", 'pages' AS parent, page_id AS parent_id FROM r WHERE topic_id NOT IN (SELECT id FROM gone_t) AND page_id IN (SELECT id FROM gone_p)""")
def restricted_delete(spark, d):
    """The readings that hold a page of a topic that should go, and stay themselves."""
    tables = _faulty(spark, d)
    return constraints.deleted(tables, "topics", tables["topics"].filter("id % 7 = 0"))[1]


# ---- an upsert into a snapshot in parts


@query(B.ORACLES["upsert_page_search"])
def upsert_in_parts(spark, d):
    """As upsert_page_search, by way of a written snapshot of which only the touched parts are rewritten."""
    stored, delta = B.stored_pages(spark, d), B.page_delta(spark, d)
    path = shared_path(stored, "parts")
    kinds = dict(f.split() for f in PAGES.split(", "))
    first = buckets.save_parts({"pages": stored.select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])}, path, 16)
    put = lambda now, top: {"pages": catalog.put_search_pages(now["pages"], delta, B.NOW, above=top["pages"])}
    second = buckets.change_parts(spark, path, first, {"pages": delta.select("topic_id")}, put)
    return buckets.read_parts(spark, second, "pages").select("id", "topic_id", "title", "url", "reading_order", "active", "verification_failures")
