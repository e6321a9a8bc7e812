"""The declared rules: every violation, and deletions along the references."""

from datetime import date, datetime

import pytest

from shelfmark import schemas
from shelfmark.operators import constraints as C
from shelfmark.sources import store

NOW = datetime(2024, 1, 15)


def made(spark, table, rows, /, **same):
    schema = spark.createDataFrame([], schemas.TABLES[table]).schema
    base = {f.name: None for f in schema} | same
    return spark.createDataFrame([base | r for r in rows], schema)


@pytest.fixture(scope="module")
def sound(spark):
    clock = {"created_at": NOW, "updated_at": NOW}
    return {
        "topics": made(spark, "topics", [{"id": i, "slug": f"s{i}"} for i in (1, 2, 3)], name="n", description="", status="active", **clock),
        "pages": made(spark, "pages", [{"id": 10 * t + k, "topic_id": t, "url": f"u{k}", "reading_order": k} for t in (1, 2, 3) for k in (1, 2)], title="t", source="", official=False, active=True, verification_failures=0, last_error="", **clock),
        "daily_readings": made(spark, "daily_readings", [{"id": 1, "topic_id": 1, "page_id": 11}, {"id": 2, "topic_id": 2, "page_id": 11}], reading_date=date(2024, 1, 1), created_at=NOW),
        "imports": store.empty_tables(spark)["imports"],
        "topic_search_runs": made(spark, "topic_search_runs", [{"id": 5, "topic_id": 1}, {"id": 6, "topic_id": 2}], provider="p", query="q", status="completed", started_at=NOW, result_count=0, stored_count=0, error="", stage=""),
        "topic_search_results": made(spark, "topic_search_results", [{"id": 7, "topic_id": 1, "search_run_id": 5, "stored_as_page_id": 12}, {"id": 8, "topic_id": 2, "search_run_id": 6, "stored_as_page_id": 12}, {"id": 9, "topic_id": 2, "search_run_id": 5, "url": "v"}], title="t", source="", snippet="", rank=1, accepted=True, created_at=NOW),
    }


def test_violations(spark, sound):
    fixed = sound | {"topic_search_results": sound["topic_search_results"].fillna({"url": "u"})}
    assert C.violations(fixed).count() == 0
    clock = {"created_at": NOW, "updated_at": NOW}
    bad_topics = made(spark, "topics", [{"id": 4, "slug": "s1", "status": "asleep"}, {"id": 4, "slug": None, "status": None}], name="n", description="", **clock)
    bad_reads = made(spark, "daily_readings", [{"id": 3, "topic_id": 1, "page_id": 99}, {"id": 4, "topic_id": 77, "page_id": 99}], reading_date=date(2024, 1, 1), created_at=NOW)
    broken = fixed | {"topics": fixed["topics"].union(bad_topics), "daily_readings": fixed["daily_readings"].union(bad_reads)}
    got = sorted((r["table"], r["rule"], r["key"], r["n"]) for r in C.violations(broken).collect())
    assert got == [
        ("daily_readings", "page_id refers to pages", "99", 2),
        ("daily_readings", "topic_id refers to topics", "77", 1),
        ("daily_readings", "topic_id, reading_date is a key", "1,2024-01-01", 2),
        ("topics", "id is a key", "4", 2),
        ("topics", "slug is a key", "s1", 2),
        ("topics", "slug is required", "4", 1),
        ("topics", "status is none of the allowed", "4", 1),
        ("topics", "status is required", "4", 1),
    ]


def test_deletions_follow_the_references(spark, sound):
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    # page 11 is held by readings of topics 1 and 2
    with pytest.raises(C.Held, match="holds pages 11"):
        C.delete(sound, "pages", ids(11))
    _, held = C.deleted(sound, "pages", ids(11, 12))
    assert sorted((r["table"], r["id"], r["parent_id"]) for r in held.collect()) == [("daily_readings", 1, 11), ("daily_readings", 2, 11)]
    # topic 1 takes its reading with it, but topic 2's reading holds its page
    _, held = C.deleted(sound, "topics", ids(1))
    assert [(r["table"], r["id"], r["parent_id"]) for r in held.collect()] == [("daily_readings", 2, 11)]
    after = C.delete(sound, "topics", ids(1, 2))
    left = {n: sorted(r["id"] for r in df.collect()) for n, df in after.items()}
    assert left == {"topics": [3], "pages": [31, 32], "daily_readings": [], "imports": [], "topic_search_runs": [], "topic_search_results": []}
    # a run's results go with it, through another topic's too
    after = C.delete(sound, "topic_search_runs", ids(5))
    assert [r["id"] for r in after["topic_search_results"].collect()] == [8] and after["pages"].count() == 6
    # a page that nobody reads: what was stored as it stays and forgets it
    after = C.delete(sound, "pages", ids(12))
    assert {r["id"]: r["stored_as_page_id"] for r in after["topic_search_results"].collect()} == {7: None, 8: None, 9: None}
    assert [f.dataType for f in after["topic_search_results"].schema] == [f.dataType for f in sound["topic_search_results"].schema]
    assert C.delete(sound, "topics", ids()).keys() == sound.keys()


def test_references_in_a_circle():
    with pytest.raises(schemas.CatalogError, match="circle"):
        C.Rules(references=(C.Reference("a", "b_id", "b"), C.Reference("b", "a_id", "a"))).order()
