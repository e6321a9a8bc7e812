from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import candidates, catalog, ledger, links, review, rotation, views
from shelfmark.sources import edges, seed, store

NOW = datetime(2024, 1, 15, 12)


def results(spark, rows):
    return spark.createDataFrame([("t", i, *r) for i, r in enumerate(rows)], schemas.CANDIDATES)


def test_candidates_drop_block_and_dedup(spark):
    rows = [("A", "https://a.example.org/x/", "s", 0.1), ("B", "https://a.example.org/x#f", "s", 0.9), (" ", "https://b.example.org", "s", 0.0), ("C", "https://sub.github.com/c", "s", 0.0), ("D", "https://d.example.org/a.PDF", "s", 0.0)]
    got = candidates.normalize_results(results(spark, rows)).collect()
    assert [(r["title"], r["url"], r["rank"], r["candidate_index"]) for r in got] == [("A", "https://a.example.org/x", 1, 1)]


def test_cap_and_reading_order(spark):
    rows = spark.createDataFrame([("t", i, i != 2) for i in range(1, 6)], "topic string, review_order int, accepted boolean")
    capped = review.capped(rows, 2).orderBy("review_order")
    assert [r["accepted"] for r in capped.collect()] == [True, False, True, False, False]
    orders = review.reading_orders(capped, F.lit(7)).orderBy("review_order").collect()
    assert [r["reading_order"] for r in orders] == [7, None, 8, None, None]


def test_rotation_and_stored_readings(spark):
    pages = spark.createDataFrame([(1, i, i, True) for i in (10, 11, 12)], "topic_id long, id long, reading_order int, active boolean")
    days = spark.createDataFrame([(1, date(1970, 1, 2)), (1, date(1969, 12, 31))], "topic_id long, reading_date date")
    assert {(r["reading_date"], r["page_id"]) for r in rotation.rotation(pages, days).collect()} == {(date(1970, 1, 2), 11), (date(1969, 12, 31), 12)}
    topics = spark.createDataFrame([(1, "x", "X", "active")], "id long, slug string, name string, status string")
    none = spark.createDataFrame([], schemas.DAILY_READINGS)
    once = rotation.get_or_create(none, days, topics, pages, NOW)
    assert rotation.get_or_create(once, days, topics, pages.filter("id = 10"), NOW).exceptAll(once).count() == 0
    with pytest.raises(schemas.InvalidDate):
        rotation.check_date(spark, "2026-6-27")


def test_limits_and_expiry(spark):
    rows = [(1, 1, "running", "reviewing", datetime(2024, 1, 15, 11)), (2, 2, "completed", "", datetime(2024, 1, 15, 11, 58))]
    runs = spark.createDataFrame([(i, t, s, g, at, None, "") for i, t, s, g, at in rows], "id long, topic_id long, status string, stage string, started_at timestamp_ntz, completed_at timestamp_ntz, error string")
    topics = spark.createDataFrame([(1, "searching", NOW), (2, "active", NOW)], "id long, status string, updated_at timestamp_ntz")
    new_topics, new_runs = ledger.expire_stale(topics, runs, NOW)
    assert {r["id"]: r["status"] for r in new_topics.collect()} == {1: "failed", 2: "active"}
    first = new_runs.filter("id = 1").first()
    assert (first["status"], first["stage"], first["error"]) == ("failed", "", ledger.STALE_ERROR)
    assert ledger.rate_limited(runs, NOW, schemas.Options().min_interval)
    assert ledger.daily_limit_reached(runs, NOW, 2) and not ledger.daily_limit_reached(runs, NOW, 3)


def test_import_twice(spark):
    tables = store.empty_tables(spark)
    text = "topic: go\nname: Go\npages:\n  - {title: A, url: 'https://a.example.org'}\n  - {title: B, url: 'https://b.example.org'}\n"
    doc = seed.read_seed(spark, text)
    catalog.check_seed(doc)
    topics, pages, imports = catalog.import_seed(tables["topics"], tables["pages"], tables["imports"], doc, NOW)
    again = seed.read_seed(spark, text.replace("A,", "A2,").replace("https://b", "https://c"))
    topics, pages, imports = catalog.import_seed(topics, pages, imports, again, NOW)
    got = {r["url"][8]: (r["title"], r["active"], r["reading_order"] > 0) for r in pages.collect()}
    assert got == {"a": ("A2", True, True), "b": ("B", False, False), "c": ("B", True, True)}
    assert catalog.duplicates(pages, ["topic_id", "url"]).count() == 0 and imports.count() == 2
    twice = seed.read_seed(spark, text.replace("https://b", "https://a"))
    with pytest.raises(schemas.InvalidSeed, match="page 2: duplicate url"):
        catalog.check_seed(twice)


def test_links(spark):
    pages = store.empty_tables(spark)["pages"]
    base = {f.name: None for f in pages.schema}
    rows = [base | {"id": i, "topic_id": 1, "url": f"u{i}", "active": True, "verification_failures": 2, "last_error": ""} for i in (1, 2, 3)]
    pages = spark.createDataFrame(rows, pages.schema)
    probes = spark.createDataFrame([(1, 404, None, ""), (2, 204, "moved", ""), (3, 200, "u1", "")], schemas.PROBES)
    got = {r["id"]: (r["url"], r["active"], r["verification_failures"], r["outcome"]) for r in links.apply_probes(pages, probes, NOW).collect()}
    assert got == {1: ("u1", False, 3, "disabled"), 2: ("moved", True, 0, "healthy"), 3: ("u3", True, 0, "conflict")}


def test_views_and_json(spark):
    topics = spark.createDataFrame([(1, "rust", "Rust", "active"), (2, "go", "Go", "active"), (3, "rube", "Rube", "failed")], "id long, slug string, name string, status string")
    assert [r["slug"] for r in views.search_topics(topics, "Ru").collect()] == ["rust"]
    assert views.exact_topic(topics, " GO ").first()["id"] == 2
    assert views.as_json(topics.limit(0)).first()["body"] == "[]"
    odd = spark.createDataFrame([("b", "<i>'1'+\"2\" & 3"), ("a", None)], "slug string, name string")
    page = views.as_html(odd, "A & B", ["slug", "name"]).first()["body"]
    assert page.endswith("<h1>A &amp; B</h1><table><tr><td>a</td><td></td></tr><tr><td>b</td><td>&lt;i&gt;&#39;1&#39;&#43;&#34;2&#34; &amp; 3</td></tr></table></body></html>")
    assert views.as_html(odd.limit(0), "", ["slug"]).first()["body"].endswith("<h1></h1><table></table></body></html>")
    body = spark.createDataFrame([('{"output":[{"content":[{"text":"a"},{"text":"b"}]},{"content":[{"text":"c"}]}]}',)], "body string")
    assert edges.answer_text(body).first()["text"] == "abc"


def test_snapshot(spark, tmp_path):
    tables = store.empty_tables(spark)
    root = store.save(tables, f"file://{tmp_path}/s", 1)
    assert store.load(spark, root)["pages"].schema == tables["pages"].schema
    applied = spark.createDataFrame([(1, "initial", NOW)], "version int, name string, applied_at timestamp_ntz")
    assert [r["version"] for r in store.migrate(applied, NOW).orderBy("version").collect()] == [1, 2, 3, 4]
    assert store.checksum(applied) == store.checksum(applied.repartition(2))


def test_search_end_to_end(spark):
    from shelfmark.plans.search import State, process_next

    tables = store.empty_tables(spark)
    topics = catalog.ensure_topics(tables["topics"], spark.createDataFrame([("rust", "Rust")], "slug string, name string"), NOW)
    state = State(topics, tables["pages"], tables["topic_search_runs"], tables["topic_search_results"])

    class Found:
        def search(self, query, most):
            return results(spark, [("Guide", "https://docs.example.org/a/b/c", "learn", 0.5), ("Home", "https://x.example.org/", "s", 0.9)]).drop("topic")

    class Judge:
        def review(self, topic, asked):
            return asked.select(F.col("index").alias("review_position"), "index", F.lit(90).alias("score"), F.lit("guide").alias("page_type"), F.lit(True).alias("should_store"), F.lit("ok").alias("reason"))

    after, error = process_next(state, Found(), Judge(), NOW)
    assert error is None
    assert [(r["url"], r["reading_order"]) for r in after.pages.collect()] == [("https://docs.example.org/a/b/c", 1)]
    assert after.results.count() == 2 and after.runs.first()["status"] == "completed" and after.topics.first()["status"] == "active"
    again, error = process_next(after, Found(), None, NOW)
    assert error is None and again.runs.count() == 1


def test_candidates_score_the_whole_page(spark, tmp_path):
    from shelfmark.plans import bindings

    filler = "<p>" + "plain words " * 100 + "</p>"
    html = "<title>Page</title>" + filler
    rows = [(1, "https://a.example.com/x/one", html), (2, "https://a.example.com/x/two", html + "<p>a tutorial</p>"), (3, "https://a.example.com/x/three", html + "<p>version 1.2</p>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    score = {r["position"]: r["score"] for r in bindings.QUERIES["interestingness_score"](spark, str(tmp_path)).filter("topic = 'x'").collect()}
    assert score[2] == score[1] + 12 and score[3] == score[1] - 15
    order = {r["url"].rsplit("/", 1)[1]: r["candidate_index"] for r in bindings.QUERIES["candidate_pipeline"](spark, str(tmp_path)).filter("topic = 'x'").collect()}
    assert order == {"two": 1, "one": 2, "three": 3}


@pytest.fixture(scope="module")
def server():
    """A local service: /ok, /moved (to /ok), /nohead (GET only), /gone, and POST /search, /review, /broken, /refused."""
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

    class Handler(BaseHTTPRequestHandler):
        asked: list[tuple[str, str, dict]] = []

        def answer(self, status, body="", **headers):
            data = body.encode()
            self.send_response(status)
            for k, v in (headers | {"Content-Length": str(len(data))}).items():
                self.send_header(k, v)
            self.end_headers()
            if self.command != "HEAD":
                self.wfile.write(data)

        def do_HEAD(self):
            if self.path == "/moved":
                return self.answer(301, Location="/ok")
            self.answer({"/ok": 204, "/nohead": 405, "/gone": 404}.get(self.path, 500))

        def do_GET(self):
            self.answer(200 if self.path in ("/ok", "/nohead") else 404)

        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            Handler.asked.append((self.path, self.headers["Authorization"], body))
            found = {"results": [{"title": "Guide", "url": "https://docs.example.org/a/b/c", "content": "learn", "score": 0.5}]}
            review = {"results": [{"index": 1, "score": 88, "page_type": " guide ", "should_store": True, "reason": "ok"}]}
            usage = {"input_tokens": 7, "output_tokens": 3, "total_tokens": 10}
            if self.path == "/search":
                self.answer(200, json.dumps(found))
            elif self.path == "/review":
                self.answer(200, json.dumps({"model": "m-1", "usage": usage, "output_text": " ", "output": [{"content": [{"text": json.dumps(review)}]}]}))
            elif self.path == "/refused":
                self.answer(429, json.dumps({"error": {"message": "too many"}}))
            else:
                self.answer(200, "no json")

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", Handler.asked
    http.shutdown()


def test_link_validation_end_to_end(spark, server):
    at, _ = server
    pages = store.empty_tables(spark)["pages"]
    base = {f.name: None for f in pages.schema} | {"topic_id": 1, "last_error": "e"}
    rows = [("/ok", True, 2), ("/moved", True, 0), ("/nohead", True, 1), ("/gone", True, 2), ("/gone2", True, 0), ("/ok?x", False, 2)]
    pages = spark.createDataFrame([base | {"id": i, "url": at + u, "active": a, "verification_failures": n} for i, (u, a, n) in enumerate(rows)], pages.schema)
    after, summary = links.validate(pages, NOW)
    got = {r["id"]: (r["url"], r["active"], r["verification_failures"], r["last_error"], r["outcome"]) for r in after.collect()}
    assert got == {
        0: (at + "/ok", True, 0, "", "healthy"),
        1: (at + "/moved", True, 0, "", "conflict"),  # its final URL is another page's
        2: (at + "/nohead", True, 0, "", "healthy"),
        3: (at + "/gone", False, 3, "unexpected status 404", "disabled"),
        4: (at + "/gone2", True, 1, "unexpected status 500", "failed"),
        5: (at + "/ok?x", False, 2, "e", None),
    }
    assert tuple(summary.first()) == (5, 3, 2, 1)


def test_services(spark, server):
    from shelfmark.plans.search import State, search_topic
    from shelfmark.sources.services import ReviewService, SearchService, ServiceError

    at, asked = server
    search, judge = SearchService(spark, at + "/search", " k "), ReviewService(spark, at + "/review", "k2", "m")
    tables, stages = store.empty_tables(spark), []
    state = State(tables["topics"], tables["pages"], tables["topic_search_runs"], tables["topic_search_results"])
    after, error = search_topic(state, "rust", "Rust", search, judge, NOW, on_stage=lambda runs: stages.append(runs.first()["stage"]))
    assert error is None and stages == ["searching", "reviewing", "storing"]
    run = after.runs.first()
    assert (run["status"], run["reviewer_model"], run["reviewer_input_tokens"], run["reviewer_output_tokens"], run["reviewer_total_tokens"]) == ("completed", "m-1", 7, 3, 10)
    result = after.results.first()
    assert (result["page_type"], result["reviewer_score"], result["accepted"]) == ("guide", 88, True)
    path, key, body = asked[0]
    assert (path, key, body["max_results"], body["query"]) == ("/search", "Bearer k", 20, "Rust specific concept tutorial guide deep dive documentation")
    path, key, body = asked[1]
    schema = body["text"]["format"]["schema"]["properties"]["results"]["items"]
    assert (path, key, body["model"], body["store"]) == ("/review", "Bearer k2", "m", False) and set(schema["required"]) == {"index", "score", "page_type", "should_store", "reason"}
    for path, told in {"/refused": "status 429, too many", "/broken": "can't be read"}.items():
        with pytest.raises(ServiceError, match=told):
            SearchService(spark, at + path, "k").search("q")
    with pytest.raises(ServiceError, match="needs a key"):
        SearchService(spark, at, " ").search("q")
    # a service's failure is the run's
    after, error = search_topic(state, "rust", "Rust", SearchService(spark, at + "/refused", "k"), None, NOW)
    assert isinstance(error, ServiceError) and after.runs.first()["status"] == "failed" and after.topics.first()["status"] == "failed"


def test_caps_and_user_parts(spark):
    rows = spark.createDataFrame([("t", i, True) for i in range(4)], "topic string, review_order int, accepted boolean")
    assert review.capped(rows, 0).filter("accepted").count() == 4
    kept = candidates.normalize_results(results(spark, [("A", "https://me@github.com/a", " s ", 0.1), ("B", "https://Me@Docs.example.org/b/", " s ", 0.1)])).collect()
    assert [(r["url"], r["host"], r["snippet"]) for r in kept] == [("https://Me@docs.example.org/b", "docs.example.org", "s")]


def test_failed_import_and_ids(spark):
    tables = store.empty_tables(spark)
    good = seed.read_seed(spark, "topic: go\nname: Go\npages:\n  - {title: A, url: 'https://a.example.org'}\n")
    bad = seed.read_seed(spark, "topic: go\nname: Go\npages: []\n")
    topics, pages, imports, error = catalog.try_import(tables["topics"], tables["pages"], tables["imports"], bad, NOW)
    assert isinstance(error, schemas.InvalidSeed) and topics.count() == pages.count() == 0
    topics, pages, imports, error = catalog.try_import(topics, pages, imports, good, NOW)
    assert error is None and [(r["id"], r["status"], r["pages_imported"]) for r in imports.orderBy("id").collect()] == [(1, "failed", 0), (2, "completed", 1)]
    two = catalog.log_import(imports, good.unionByName(bad.withColumn("topic", F.lit("zig"))), "completed", "", NOW)
    assert sorted(r["id"] for r in two.collect()) == [1, 2, 3, 4]
    twice = spark.createDataFrame([("a", "A"), ("a", "B")], "slug string, name string")
    with pytest.raises(Exception, match="key occurs twice"):
        catalog.ensure_topics(topics, twice, NOW).collect()


def test_publish_and_restore(spark, tmp_path):
    base = f"file://{tmp_path}/db"
    tables = store.empty_tables(spark)
    assert store.current(spark, base) is None
    first = store.save(tables, base, 1)
    store.publish(spark, base, first)
    tables["topics"] = catalog.ensure_topics(tables["topics"], spark.createDataFrame([("go", "Go")], "slug string, name string"), NOW)
    second = store.save(tables, base, 2)
    assert store.current(spark, base) == first  # not seen before it is published
    store.publish(spark, base, second)
    assert store.current(spark, base) == second and store.verify(spark, second) == []
    root, before = store.restore(spark, first, base, 3)
    assert before == second and store.current(spark, base) == root and store.load(spark, root)["topics"].count() == 0
    tables["topics"].limit(0).write.mode("overwrite").parquet(f"{second}/topics.parquet")
    assert store.verify(spark, second) == ["topics"]
    with pytest.raises(schemas.CatalogError, match="damaged: topics"):
        store.restore(spark, second, base, 4)
    assert store.verify(spark, f"{base}/none") == ["manifest"]


def test_numbers_of_many_partitions(spark):
    from shelfmark.numbering import number_rows

    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.lit("x").alias("v")).repartition(7)
    assert [(r["k"], r["n"]) for r in number_rows(rows, ["k"], "n", F.lit(5)).collect() if r["n"] != r["k"] + 5] == []
    assert number_rows(rows.limit(0), ["k"], "n").count() == 0


def test_numbers_in_groups(spark):
    from shelfmark.numbering import number_in_groups, number_rows

    rows = spark.range(500).select((F.col("id") * 7 % 11).alias("g"), (F.col("id") * 37 % 500).alias("k"))
    took = lambda df: sorted((r["g"], r["k"], r["n"]) for r in df.collect())
    assert took(number_in_groups(rows, "g", ["k"], "n")) == took(number_rows(rows, ["g", "k"], "n"))
    assert number_in_groups(rows.limit(0), "g", ["k"], "n").count() == 0


def test_parts_of_odd_urls(spark):
    """The URL's parts, each taken once, are those of the plain functions; what is blocked before the first
    rows are taken is blocked after."""
    from shelfmark.functions import scalars as S
    from shelfmark.operators import candidates

    urls = ["HTTP://WWW.Example.COM/A.PDF?x=1#y", " https://h.example.com/a.pdf /", "\u00a0https://Me:pw@Ex.org/In/", "https://me@/a", "https:// ", "https://h //", "https://a@b@C/x//", "ftp://a.b/c", "x https://a/b",
            "http\u017f://a/b", "https://", "https://?a", "https://a\nb@C/d", "https://facebook.com", "https://x.facebook.com:80/a", "https://notfacebook.com/a", "https://www.facebook.com/a/", "", None, "https://a/b.pdf\n", "https://a/pdf", "HTTPS://a/\u00e9/ "]
    rows = spark.createDataFrame([("t", i, f" Guide {i}\t" if i % 7 else "Guide", u, None if i % 2 else "\u00a0learn ", 0.5) for i, u in enumerate(urls)] + [("t", 99, " \u00a0", "https://a/z", "", 0.5)], "topic string, position int, title string, url string, snippet string, provider_score double")
    plain = rows.filter(S.url_valid(F.col("url")) & (S.strip(F.col("title")) != "")).select("position", S.strip(F.col("title")).alias("title"), S.strip(F.coalesce("snippet", F.lit(""))).alias("snippet"), S.url_host(F.col("url")).alias("host"), S.normalize_url(F.col("url")).alias("url"))
    took = lambda df: sorted(tuple(r) for r in df.collect())
    assert took(candidates.usable(rows).select(*plain.columns)) == took(plain) and plain.count() > 10
    bare = F.regexp_replace(F.col("host"), r"^www\.", "")
    for domains in (None, ["c", "example.com"], []):
        from shelfmark.schemas import BLOCKED_DOMAINS

        known = BLOCKED_DOMAINS if domains is None else domains
        hit = F.lower(S.url_path(F.col("url"))).endswith(".pdf")
        for d in known:
            hit = hit | (bare == d) | bare.endswith("." + d)
        want = candidates.first_occurrences(plain.filter(~hit).withColumn("topic", F.lit("t"))).select("position", "url")
        assert took(candidates.normalize_results(rows, domains).select("position", "url")) == took(want)
