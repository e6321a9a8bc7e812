"""Snapshots in parts: what is written and read is counted."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.operators import catalog
from shelfmark.sources import buckets, store

NOW = datetime(2024, 1, 15)


@pytest.fixture(scope="module")
def tables(spark):
    empty = store.empty_tables(spark)
    topics = spark.createDataFrame([(i, f"s{i}", f"S{i}", "", "active", NOW, NOW) for i in range(1, 101)], schemas.TOPICS)
    base = {f.name: None for f in empty["pages"].schema} | {"title": "t", "source": "", "official": False, "active": True, "verification_failures": 0, "last_error": "", "created_at": NOW, "updated_at": NOW}
    pages = spark.createDataFrame([base | {"id": i, "topic_id": i % 100 + 1, "url": f"u{i}", "reading_order": i} for i in range(1, 501)], empty["pages"].schema)
    return {"topics": topics, "pages": pages, "topic_search_runs": empty["topic_search_runs"]}


def test_a_change_writes_only_its_parts(spark, tables, tmp_path):
    path, n = f"file://{tmp_path}/db", 16
    first = buckets.save_parts(tables, path, n)
    store.publish(spark, path, first.root, 0)
    assert buckets.open_parts(spark, store.current(spark, path)) == first
    for name, df in tables.items():
        assert buckets.read_parts(spark, first, name).exceptAll(df).count() == 0 and sum(r[3] for r in first.rows if r[0] == name) == df.count()
    # new and known pages of two topics
    delta = spark.createDataFrame([(3, "u2", "new title", "s", 7, 1), (3, "x", "X", "s", 8, 1), (40, "y", "Y", "s", 9, 1)], "topic_id long, url string, title string, source string, reading_order int, search_run_id long")
    put = lambda now, top: {"pages": catalog.put_search_pages(now["pages"], delta, NOW, above=top["pages"])}
    second = buckets.commit_parts(spark, path, {"pages": delta.select("topic_id")}, put)
    mine = buckets.parts_of(delta.select("topic_id"), "pages", n)
    assert len(mine) <= 2 and {r[1] for r in second.rows if r[2] == second.root} == mine and {r[0] for r in second.rows if r[2] == second.root} == {"pages"}
    written = list((tmp_path / "db" / second.root.rsplit("/", 1)[1]).glob("*/_part=*/*.parquet"))
    assert len(written) == len(mine)
    # the same as the whole tables would be, ids too
    want = catalog.put_search_pages(tables["pages"], delta, NOW)
    got = buckets.read_parts(spark, second, "pages")
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    # a reader of one topic opens one part of 16
    one = buckets.parts_of(spark.createDataFrame([(40,)], "topic_id long"), "pages", n)
    some = buckets.read_parts(spark, second, "pages", one)
    assert len(some.inputFiles()) == 1 and len(got.inputFiles()) > 10
    assert some.filter("topic_id = 40").count() == want.filter("topic_id = 40").count() == 6
    assert buckets.live_roots([second]) == {first.root, second.root}


def test_parts_of_two_writers(spark, tables, tmp_path):
    path = f"file://{tmp_path}/db"
    store.publish(spark, path, buckets.save_parts(tables, path, 4).root, 0)
    page = lambda t, u: spark.createDataFrame([(t, u, "T", "s", 1, 1)], "topic_id long, url string, title string, source string, reading_order int, search_run_id long")
    put = lambda d: lambda now, top: {"pages": catalog.put_search_pages(now["pages"], d, NOW, above=top["pages"])}
    calls = []

    def slow(now, top):
        calls.append(1)
        if len(calls) == 1:
            other = page(5, "other")
            buckets.commit_parts(spark, path, {"pages": other.select("topic_id")}, put(other))
        return put(page(9, "mine"))(now, top)

    made = buckets.commit_parts(spark, path, {"pages": page(9, "mine").select("topic_id")}, slow)
    rows = buckets.read_parts(spark, made, "pages")
    assert len(calls) == 2 and {(r["id"], r["url"]) for r in rows.filter(F.col("id") > 500).collect()} == {(501, "other"), (502, "mine")}
    with pytest.raises(schemas.CatalogError, match="weren't read"):
        stray = lambda now, top: {"pages": now["pages"].withColumn("topic_id", F.col("topic_id") + F.col("id"))}
        buckets.commit_parts(spark, path, {"pages": page(9, "mine").select("topic_id")}, stray)
