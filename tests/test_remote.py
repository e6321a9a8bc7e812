"""Searches, reviews and probes that tasks make, against a local server that counts what it is asked."""

import json
import threading
import time
from collections import Counter, defaultdict
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from shelfmark.sources import edges
from shelfmark.sources.remote import Caller, side_by_side
from shelfmark.sources.review_source import ReviewAll
from shelfmark.sources.search_source import ROWS, SearchAll, SearchReader, SearchSource, failed_queries, found_results


class Server:
    """What was asked, how often, and how many requests were answered at once."""

    def __init__(self):
        self.lock, self.asked, self.now, self.most, self.starts = threading.Lock(), Counter(), 0, 0, defaultdict(list)
        self.bodies = []

    def search(self, query):
        n = sum(map(ord, query))
        if query == "flaky":
            return (503, "{}") if self.asked[query] < 3 else (200, json.dumps({"results": [{"title": "T", "url": "https://a.example.org/x", "content": None, "score": 1}]}))
        if query == "refused":
            return 403, json.dumps({"error": "no"})
        if query == "busy":
            return 429, json.dumps({"error": {"message": "too many"}})
        if query == "odd":
            return 200, "[1]"
        if query == "broken":
            return 200, "no json"
        return 200, json.dumps({"results": [{"title": f"{query} {i}", "url": f"https://a.example.org/{n}/{i}", "content": "learn", "score": i / 4} for i in range(n % 4)]})

    def review(self, topic, body):
        if topic == "bad":
            return 500, json.dumps({"error": {"message": "down"}})
        if topic == "mute":
            return 200, json.dumps({"output_text": " "})
        if topic == "prose":
            return 200, json.dumps({"output_text": "I think they are fine"})
        found = json.loads(body["input"][1]["content"])["candidates"]
        results = [{"index": c["index"], "score": 70 + c["index"], "page_type": "guide", "should_store": True, "reason": c["title"]} for c in found]
        return 200, json.dumps({"model": "m-1", "usage": {"input_tokens": len(found), "output_tokens": 2, "total_tokens": len(found) + 2}, "output": [{"content": [{"text": json.dumps({"results": results})}]}]})


@pytest.fixture
def server():
    state = Server()

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            key = body["query"] if self.path == "/search" else json.loads(body["input"][1]["content"])["topic"]
            with state.lock:
                state.asked[key] += 1
                state.now += 1
                state.most = max(state.most, state.now)
                state.bodies.append(body)
            time.sleep(0.03)
            status, text = state.search(key) if self.path == "/search" else state.review(key, body)
            with state.lock:
                state.now -= 1
            data = text.encode()
            self.send_response(status)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_HEAD(self):
            with state.lock:
                state.now += 1
                state.most = max(state.most, state.now)
                state.starts[self.headers["Host"]].append(time.time())
            time.sleep(0.02)
            status = 404 if "gone" in self.path else 405 if "nohead" in self.path else 503 if "weak" in self.path and state.asked[self.path] == 0 else 200
            with state.lock:
                state.asked[self.path] += 1
                state.now -= 1
            self.send_response(status)
            self.send_header("Content-Length", "0")
            self.end_headers()

        do_GET = lambda self: (self.send_response(200), self.send_header("Content-Length", "0"), self.end_headers())

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    http.daemon_threads = True
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", state
    http.shutdown()


def test_side_by_side_keeps_order_and_width():
    now, most, lock = [0], [0], threading.Lock()

    def call(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.01 * (x % 3))
        with lock:
            now[0] -= 1
        return x * x

    assert list(side_by_side(call, range(20), 4)) == [(i, i * i) for i in range(20)] and most[0] <= 4
    assert list(side_by_side(call, [], 4)) == []


def test_caller_repeats_what_may_pass(server):
    at, state = server
    body = lambda q: json.dumps({"query": q}).encode()
    reply = Caller(at + "/search", "k", wait=0.01).ask(body("flaky"))
    assert (reply.status, reply.attempts, reply.error) == (200, 3, "")
    assert Caller(at + "/search", "k", wait=0.01).ask(body("refused")).attempts == 1
    assert Caller(at + "/search", "k", attempts=2, wait=0.01).ask(body("busy")).attempts == 2
    gone = Caller("http://127.0.0.1:1/x", "k", attempts=2, wait=0.01, timeout=1).ask(b"{}")
    assert gone.status is None and gone.attempts == 2 and "no answer" in gone.error


def test_search_as_a_data_source(spark, server, tmp_path):
    at, state = server
    names = [f"q{i}" for i in range(40)] + ["flaky", "refused", "busy", "odd", "broken", "q3"]
    path = f"file://{tmp_path}/queries"
    spark.createDataFrame([(f"t{i}", q) for i, q in enumerate(names)], "topic string, query string").repartition(3).write.parquet(path)
    reader = SearchReader({"path": path, "endpoint": at, "token": "k", "batch": "5"})
    assert sum(p.stop - p.start for p in reader.partitions()) == len(names) and max(p.stop - p.start for p in reader.partitions()) == 5
    assert not state.asked  # planning asks nothing
    spark.dataSource.register(SearchSource)
    read = spark.read.format("catalog_search").options(endpoint=at + "/search", token=" k ", batch=5, in_flight=2, wait=0.01, max_results=7).load(path)
    assert read.schema == spark.createDataFrame([], ROWS).schema
    rows = [r.asDict() for r in read.collect()]
    assert state.most <= 8  # 4 tasks with 2 in flight
    assert {b["max_results"] for b in state.bodies} == {7} and state.asked["flaky"] == 3 and state.asked["q5"] == 1 and state.asked["q3"] == 2
    by = defaultdict(list)
    for r in rows:
        by[r["topic"]].append(r)
    assert set(by) == {f"t{i}" for i in range(len(names))}
    errors = {names[int(t[1:])]: r[0]["error"] for t, r in by.items() if r[0]["error"]}
    assert set(errors) == {"refused", "busy", "odd", "broken"} and errors["refused"].endswith("status 403, no") and errors["busy"].endswith("too many")
    # the same rows as the decoding of the answers
    bodies = spark.createDataFrame([(f"t{i}", state.search(q)[1]) for i, q in enumerate(names) if q not in errors], "topic string, body string")
    want = sorted(map(str, edges.decode_results(bodies).collect()))
    assert sorted(map(str, spark.createDataFrame([r for r in rows], ROWS).transform(found_results).collect())) == want
    with pytest.raises(Exception, match="needs a token"):
        spark.read.format("catalog_search").options(endpoint=at, token=" ").load(path).collect()


def test_search_all_asks_once(spark, server):
    at, state = server
    queries = spark.createDataFrame([("a", "q1"), ("b", "refused"), ("c", "q4")], "topic string, query string")
    rows = SearchAll(spark, at + "/search", "k", wait=0.01).search_all(queries)
    assert rows.count() == rows.count() and sum(state.asked.values()) == 3
    assert [(r["topic"], r["query"]) for r in failed_queries(rows).collect()] == [("b", "refused")]
    assert SearchAll(spark, at + "/search", "k").search_all(queries.limit(0)).count() == 0


def test_reviews_of_many_topics(spark, server):
    at, state = server
    topics = [f"t{i}" for i in range(20)] + ["bad", "mute", "prose"]
    asked = spark.createDataFrame([(t, t, i, f"{t} page {i}", "u", "s", "x", i) for t in topics for i in range(1, 4)], "topic string, name string, index int, title string, url string, source string, snippet string, rank int")
    reviews, told = ReviewAll(spark, at + "/review", "k", "m", attempts=2, wait=0.01, at_once=4, in_flight=2).review_all(asked.repartition(5))
    got = {r["topic"]: r for r in told.collect()}
    assert set(got) == set(topics) and 1 < state.most <= 4
    assert {t: r["error"] for t, r in got.items() if r["error"]} == {"bad": "the review service failed: status 500, down", "mute": "the review has no text", "prose": "the review can't be read"}
    assert (got["t3"]["model"], got["t3"]["input_tokens"], got["t3"]["output_tokens"], got["t3"]["total_tokens"], got["bad"]["attempts"]) == ("m-1", 3, 2, 5, 2)
    assert sorted((r["topic"], r["index"], r["score"], r["reason"]) for r in reviews.collect()) == sorted((t, i, 70 + i, f"{t} page {i}") for t in topics[:20] for i in range(1, 4))
    assert state.asked["t5"] == 1 and state.asked["bad"] == 2  # a topic is asked once, however often it is read
    kinds = state.bodies[0]["text"]["format"]["schema"]["properties"]["results"]["items"]["properties"]
    assert len(kinds["page_type"]["enum"]) == 11 and kinds["reason"]["maxLength"] == 240


def test_queue_over_the_services(spark, server):
    """From the queue to stored pages, with a topic whose review fails and one whose search does."""
    from datetime import datetime

    from shelfmark import schemas
    from shelfmark.plans.queue import process_queue
    from shelfmark.plans.search import State
    from shelfmark.sources import store

    at, state = server
    now, tables = datetime(2024, 1, 15, 12), store.empty_tables(spark)
    made = [(i, f"t{i}", n, "", "queued", now, now) for i, n in enumerate(["one", "two", "bad", "three"], 1)]
    start = State(spark.createDataFrame(made, schemas.TOPICS), tables["pages"], tables["topic_search_runs"], tables["topic_search_results"])
    after, outcome, error = process_queue(start, SearchAll(spark, at + "/search", "k"), ReviewAll(spark, at + "/review", "k", "m", wait=0.01), now, schemas.Options(max_results=2))
    assert error is None
    n = {t: sum(map(ord, t + " specific concept tutorial guide deep dive documentation")) % 4 for t in ("one", "two", "bad", "three")}
    got = {r["slug"]: (r["status"], r["stored"]) for r in outcome.collect()}
    assert got == {f"t{i}": ("completed", min(2, n[t])) if n[t] and t != "bad" else ("failed", 0) for i, t in enumerate(n, 1)}
    assert after.pages.count() == sum(s for _, s in got.values()) and after.runs.filter("status = 'running'").count() == 0


def test_polite_probes(spark, server):
    at, state = server
    port = at.rsplit(":", 1)[1]
    hosts = ["127.0.0.1", "localhost"]
    paths = ["/ok1", "/ok2", "/gone", "/nohead", "/weak", "/ok3"]
    rows = [(i, f"http://{h}:{port}{p}/{h}") for i, (h, p) in enumerate((h, p) for h in hosts for p in paths)]
    rows += [(90, "http://127.0.0.1:1/none"), (91, "no url"), (92, None)]
    pages = spark.createDataFrame(rows, "id long, url string").repartition(4)
    got = {r["page_id"]: r for r in edges.probe_politely(pages, at_once=4, in_flight=2, delay=0.05, timeout=2).collect()}
    assert len(got) == len(rows)
    for i, u in rows:
        want = None if i >= 90 else 404 if "gone" in u else 503 if "weak" in u else 200
        assert got[i]["http_status"] == want, u
        assert bool(got[i]["error"]) == (i >= 90)
    assert state.most <= 2  # one of each host
    for times in state.starts.values():
        assert all(b - a >= 0.045 for a, b in zip(sorted(times), sorted(times)[1:]))
    assert edges.probe_politely(pages.limit(0)).count() == 0
