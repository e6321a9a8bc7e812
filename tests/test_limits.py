"""The limits over whole ledgers, moved URLs, and the whole queue at once: each against one by one."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import admission, catalog, links, moves
from shelfmark.plans.queue import process_queue
from shelfmark.plans.search import State, process_next
from shelfmark.sources import store

NOW = datetime(2024, 1, 15, 12)


def one_by_one(rows, interval):
    """ids of the admitted (key, at, id): the last admitted one decides."""
    last, out = {}, set()
    for key, at, i in sorted((r for r in rows if r[1] is not None), key=lambda r: (r[1], r[2])):
        if key not in last or at - last[key] >= interval:
            last[key] = at
            out.add(i)
    return out


@pytest.mark.parametrize("seconds,spread,block", [(300, 100_000, None), (300, 4000, timedelta(minutes=5)), (60, 100_000, timedelta(hours=1)), (3600, 2_000_000, timedelta(hours=1)), (1, 300, None)])
def test_replay_against_one_by_one(spark, seconds, spread, block):
    own = random.Random(seconds + spread)
    start = datetime(1969, 12, 31, 23)  # times before the epoch too
    rows = [(own.choice(["a", "b", None]), start + timedelta(seconds=own.randrange(spread), microseconds=own.choice([0, 0, 1, 999_999])), i) for i in range(900)]
    rows += [("a", None, 900), ("c", start, 901), ("c", start, 902), ("c", start + timedelta(seconds=seconds), 903), ("c", start + timedelta(seconds=seconds, microseconds=-1), 904)]
    df = spark.createDataFrame(rows, "user string, started_at timestamp_ntz, id long").repartition(3)
    interval = timedelta(seconds=seconds)
    got = {r["id"] for r in admission.replay(df, interval, ["user"], block=block).collect() if r["admitted"]}
    assert got == one_by_one(rows, interval)
    alone = {r["id"] for r in admission.replay(df, interval, block=block).collect() if r["admitted"]}
    assert alone == one_by_one([("", t, i) for _, t, i in rows], interval)
    if block is None:
        assert admission.replay(df.limit(0), interval).count() == 0
        assert admission.replay(df, timedelta(0)).filter("admitted").count() == len(rows) - 1


def test_replay_holds_blocks_together(spark):
    # as in a large ledger: that the blocks' entries are few is seen at run time only, and several tasks read the times
    own, start, interval = random.Random(7), datetime(2024, 1, 1), timedelta(minutes=5)
    rows = [(own.randrange(20), start + timedelta(seconds=own.randrange(40_000)), i) for i in range(4000)]
    df = spark.createDataFrame(rows, "user long, started_at timestamp_ntz, id long").repartition(4)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "16KB", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = [r["id"] for r in admission.replay(df, interval, ["user"]).collect() if r["admitted"]]
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert sorted(got) == sorted(one_by_one(rows, interval))


def test_admitted_by_day(spark):
    rows = [(f"d{i % 3}", i) for i in range(20)]
    used = spark.createDataFrame([("d0", 3), ("d2", 9)], "day string, n_runs long")
    got = admission.admitted(spark.createDataFrame(rows, "day string, id long"), used, 5, ["day"], ["id"]).filter("admitted").collect()
    assert sorted(r["id"] for r in got) == sorted([0, 3, 1, 4, 7, 10, 13])


def moved_in_order(pages, wanted):
    """Pages take their URLs one after another."""
    held = {(t, u): i for i, t, u in pages}
    out = {}
    for i, t, u in sorted(pages):
        if i in wanted and wanted[i] != u:
            out[i] = (t, wanted[i]) not in held
            if out[i]:
                del held[(t, u)]
                held[(t, wanted[i])] = i
    return out


def test_moves_against_their_order(spark):
    for seed in range(4):
        own = random.Random(seed)
        pages = [(i, i % 2, f"u{i}") for i in range(120)]
        wanted = {i: f"u{own.choice([i - 2, i - 4, i + 2, i, own.randrange(130), 200 + own.randrange(20)])}" for i in range(120) if own.random() < 0.8}
        p = spark.createDataFrame(pages, "id long, topic_id long, url string")
        m = spark.createDataFrame(list(wanted.items()), "id long, final_url string")
        assert {r["id"]: r["moved"] for r in moves.resolve_moves(p, m).collect()} == moved_in_order(pages, wanted)
    # a long chain, which is free at its end or held there
    pages = [(i, 1, f"u{i}") for i in range(200)]
    p = spark.createDataFrame(pages, "id long, topic_id long, url string")
    for end in ("free", "u199"):
        wanted = {i: f"u{i - 1}" if i else end for i in range(199)}
        m = spark.createDataFrame(list(wanted.items()), "id long, final_url string")
        assert {r["moved"] for r in moves.resolve_moves(p, m).collect()} == {end == "free"}


def test_links_that_moved_onto_each_other(spark):
    pages = store.empty_tables(spark)["pages"]
    base = {f.name: None for f in pages.schema}
    rows = [base | {"id": i, "topic_id": 1, "url": f"u{i}", "active": True, "verification_failures": 1, "last_error": ""} for i in range(1, 7)]
    pages = spark.createDataFrame(rows, pages.schema)
    # 1 leaves, 2 takes its place; 3 and 4 would change places; 5 and 6 want the same
    probes = spark.createDataFrame([(1, 200, "new", ""), (2, 200, "u1", ""), (3, 200, "u4", ""), (4, 200, "u3", ""), (5, 200, "x", ""), (6, 200, "x", "")], schemas.PROBES)
    got = {r["id"]: (r["url"], r["outcome"]) for r in links.apply_probes(pages, probes, NOW).collect()}
    assert got == {1: ("new", "healthy"), 2: ("u1", "healthy"), 3: ("u3", "conflict"), 4: ("u4", "conflict"), 5: ("x", "healthy"), 6: ("u6", "conflict")}


# ---- the whole queue


def found_for(slug):
    """Candidates of a topic; some have none, and one's search fails."""
    n = sum(map(ord, slug))
    if slug == "t-2":
        return None
    if slug == "t-3":
        return []
    return [(f"Guide {slug} {i}", f"https://docs.example.org/{slug}/a/{(n + i * 7) % 9}", "learn" if i % 2 else "plain", i / 10) for i in range(n % 4 + 3)]


def verdict_for(slug, index):
    return (index * 37 + len(slug)) % 60 + 41, index % 4 != 0


class OneProvider:
    def __init__(self, spark):
        self.spark = spark

    def search(self, query, most):
        slug = query.split(" ")[0].lower().replace("topic", "t-")
        rows = found_for(slug)
        if rows is None:
            raise RuntimeError("no answer")
        return self.spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "position int, title string, url string, snippet string, provider_score double")


class OneReviewer:
    def review(self, topic, asked):
        slug = topic.lower().replace("topic", "t-")
        if slug == "t-4":
            raise RuntimeError("refused")
        rows = [(r["index"], r["index"], *verdict_for(slug, r["index"])) for r in asked.collect()]
        made = asked.sparkSession.createDataFrame([(p, i, s, "guide", k, "ok") for p, i, s, k in rows], "review_position int, index int, score int, page_type string, should_store boolean, reason string")
        return made


class AllProvider:
    def search_all(self, queries, most):
        out = []
        for r in queries.collect():
            rows = found_for(r["topic"])
            out += [(r["topic"], r["query"], i, *x, 1, "") for i, x in enumerate(rows or [])]
            if not rows:
                out.append((r["topic"], r["query"], None, None, None, None, None, 1, "no answer" if rows is None else ""))
        from shelfmark.sources.search_source import ROWS

        return queries.sparkSession.createDataFrame(out, ROWS)


class AllReviewer:
    def review_all(self, asked):
        rows = asked.collect()
        reviews = [(r["topic"], r["index"], r["index"], verdict_for(r["topic"], r["index"])[0], "guide", verdict_for(r["topic"], r["index"])[1], "ok") for r in rows if r["topic"] != "t-4"]
        told = [(t, "", 0, 0, 0, 1, "refused" if t == "t-4" else "") for t in sorted({r["topic"] for r in rows})]
        spark = asked.sparkSession
        return spark.createDataFrame(reviews, schemas.REVIEWS), spark.createDataFrame(told, "topic string, model string, input_tokens int, output_tokens int, total_tokens int, attempts int, error string")


def queued(spark, n, limit_used=0):
    tables = store.empty_tables(spark)
    made = [(i, f"t-{i}", f"Topic{i}", "", "queued", NOW - timedelta(days=1, minutes=(i * 5) % 7), NOW) for i in range(1, n + 1)]
    topics = spark.createDataFrame(made, schemas.TOPICS)
    pages = tables["pages"]
    old = {f.name: None for f in pages.schema} | {"official": False, "active": False, "verification_failures": 2, "last_error": "", "title": "old", "source": "s"}
    held = [old | {"id": 10 + i, "topic_id": i, "url": f"https://docs.example.org/t-{i}/a/{i % 9}", "reading_order": 4, "created_at": NOW, "updated_at": NOW} for i in range(1, 4)]
    run = {f.name: None for f in tables["topic_search_runs"].schema} | {"provider": "search", "query": "q", "error": "", "stage": "", "result_count": 0, "stored_count": 0}
    past = [run | {"id": i, "topic_id": 1, "status": "completed", "started_at": NOW - timedelta(hours=2), "completed_at": NOW} for i in range(1, limit_used + 1)]
    stale = [run | {"id": 90, "topic_id": 2, "status": "running", "stage": "searching", "started_at": NOW - timedelta(hours=5)}]
    return State(topics, spark.createDataFrame(held, pages.schema), spark.createDataFrame(past + stale, tables["topic_search_runs"].schema), tables["topic_search_results"])


def rows_of(df):
    return sorted(map(str, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


@pytest.mark.parametrize("judged,n", [(True, 6), (False, 3)])
def test_queue_equals_one_by_one(spark, judged, n):
    options = schemas.Options(max_results=3, daily_limit=n + 2)
    state = queued(spark, n, limit_used=2)  # with the stale run 3 are used
    after, outcome, error = process_queue(state, AllProvider(), AllReviewer() if judged else None, NOW, options)
    assert error is None and outcome.count() == n - 1
    one, clock = state, NOW
    for _ in range(20):
        one, error = process_next(one, OneProvider(spark), OneReviewer() if judged else None, clock, options)
        if isinstance(error, schemas.RateLimited):
            break
        clock += options.min_interval
    for name in ("topics", "pages", "runs", "results"):
        assert rows_of(getattr(after, name)) == rows_of(getattr(one, name)), name
    assert after.topics.filter("status = 'queued'").count() == 1


def test_queue_limits(spark):
    state = queued(spark, 3)
    used_up, outcome, error = process_queue(state, AllProvider(), None, NOW, schemas.Options(daily_limit=1))
    assert used_up is state and outcome is None and isinstance(error, schemas.RateLimited)
    busy = State(state.topics, state.pages, state.runs.withColumn("started_at", F.lit(NOW - timedelta(minutes=3)).cast("timestamp_ntz")), state.results)
    after, outcome, error = process_queue(busy, AllProvider(), None, NOW)
    assert outcome is None and isinstance(error, schemas.RateLimited) and after.runs.filter("status = 'rate_limited'").count() == 1
    empty = State(state.topics.limit(0), state.pages, state.runs, state.results)
    assert process_queue(empty, AllProvider(), None, NOW)[1:] == (None, None)
    # over midnight the next day's runs count
    late = datetime(2024, 1, 15, 23, 58)
    _, outcome, _ = process_queue(queued(spark, 6), AllProvider(), None, late, schemas.Options(daily_limit=3))
    assert [(r["place"], r["started"].day) for r in outcome.orderBy("place").collect()] == [(1, 15), (2, 16), (3, 16), (4, 16)]


def test_queue_knows_topics_by_id(spark):
    """Topics that share a slug are each asked, stored and settled once, and don't multiply one another."""
    from shelfmark.sources.search_source import ROWS

    class ById:
        def search_all(self, queries, most):
            asked = queries.collect()
            assert len(asked) == len({r["topic"] for r in asked}) == 6
            rows = [(r["topic"], r["query"], i, f"Guide {i}", f"https://docs.example.org/{r['topic_id']}/a/{i}", "", 0.5, 1, "") for r in asked if r["topic_id"] != 5 for i in range(r["topic_id"])]
            lost = [(r["topic"], r["query"], None, None, None, None, None, 1, "no answer") for r in asked if r["topic_id"] == 5]
            return spark.createDataFrame(rows + lost, ROWS)

    class Judge:
        def review_all(self, asked):
            ids = {r["topic"]: r["topic_id"] for r in asked.collect()}
            reviews = [(r["topic"], r["index"], r["index"], 90, "guide", r["index"] != 2, "ok") for r in asked.collect()]
            told = [(t, "m", i, 0, 0, 1, "") for t, i in ids.items()]
            return spark.createDataFrame(reviews, schemas.REVIEWS), spark.createDataFrame(told, "topic string, model string, input_tokens int, output_tokens int, total_tokens int, attempts int, error string")

    state = queued(spark, 6)
    state = State(state.topics.withColumn("slug", F.when(F.col("id") < 6, "t-1").otherwise(F.col("slug"))), state.pages, state.runs, state.results)
    after, outcome, error = process_queue(state, ById(), Judge(), NOW, schemas.Options(max_results=3, min_interval=timedelta(0)))
    assert error is None
    want = {i: ("failed", "t-1", 0, 0, "no answer") if i == 5 else ("completed", "t-1" if i < 6 else "t-6", i, min(3, i - (i > 1)), "") for i in range(1, 7)}
    assert {r["topic_id"]: (r["status"], r["slug"], r["total"], r["stored"], r["error"]) for r in outcome.collect()} == want
    assert {r["id"]: r["status"] for r in after.topics.collect()} == {i: "failed" if i == 5 else "active" for i in want}
    got = sorted((r["topic_id"], r["url"]) for r in after.results.collect())
    assert got == sorted((i, f"https://docs.example.org/{i}/a/{k}") for i in want if i != 5 for k in range(i))
    place = {r["topic_id"]: r["place"] for r in outcome.collect()}
    numbered = [(place[r["topic_id"]], r["topic_id"], r["url"]) for r in after.results.orderBy("id").collect()]
    assert numbered == sorted(numbered) and [r["id"] for r in after.results.orderBy("id").collect()] == list(range(1, len(numbered) + 1))


def test_queue_counts_later_runs_only(spark):
    """A day's runs are those that started on it or later, as they stand in the ledger."""
    from shelfmark.plans.queue import admissions

    state = queued(spark, 6)
    one = state.runs.first().asDict()
    made = [one | {"id": i, "status": s, "started_at": t} for i, (s, t) in enumerate([("completed", NOW - timedelta(days=1)), ("completed", NOW), ("rate_limited", NOW), ("failed", NOW + timedelta(days=1)), ("completed", NOW + timedelta(days=2))], 1)]
    runs = spark.createDataFrame(made, state.runs.schema)
    fits = lambda limit: admissions(state.topics, runs, NOW, schemas.Options(daily_limit=limit, min_interval=timedelta(0)), 10).count()
    assert [fits(n) for n in (3, 4, 6, 20)] == [0, 1, 3, 6]


# ---- publishing


def test_no_update_is_lost(spark, tmp_path):
    base = f"file://{tmp_path}/db"
    add = lambda slug: lambda tables: tables | {"topics": catalog.ensure_topics(tables["topics"], spark.createDataFrame([(slug, slug)], "slug string, name string"), NOW)}
    store.commit(spark, base, add("a"))
    calls = []

    def slow(tables):
        calls.append(1)
        if len(calls) == 1:
            store.commit(spark, base, add("b"))  # another writer, in between
        return add("c")(tables)

    store.commit(spark, base, slow)
    assert len(calls) == 2
    topics = store.load(spark, store.current(spark, base))["topics"]
    assert [(r["id"], r["slug"]) for r in topics.orderBy("id").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    read = store.pointer(spark, base)
    root = store.save(store.empty_tables(spark), base, label="late")
    store.commit(spark, base, add("d"))
    with pytest.raises(store.Outdated):
        store.publish(spark, base, root, read)
    # a claim that another writer just made, and one that was left long ago
    n = store.pointer(spark, base)
    (tmp_path / "db" / "claims" / f"{n + 1:08d}").write_text("")
    with pytest.raises(store.Outdated):
        store.publish(spark, base, root, n)
    import os

    os.utime(tmp_path / "db" / "claims" / f"{n + 1:08d}", (1, 1))
    assert store.publish(spark, base, root, n) == n + 2
