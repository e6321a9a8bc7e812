"""Streams against the batch operators."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from shelfmark.operators import catalog, ledger
from shelfmark.sources import store
from shelfmark.streaming.batches import fold
from shelfmark.streaming.expiry import finished_runs

START = datetime(2024, 1, 15, 12)


def files(spark, folder, batches, schema):
    """A stream that reads one batch after another."""
    import json
    import os

    os.makedirs(folder, exist_ok=True)
    for n, rows in enumerate(batches):
        with open(f"{folder}/{n:03d}.json", "w") as f:
            f.write("\n".join(json.dumps(r) for r in rows))
        os.utime(f"{folder}/{n:03d}.json", (1_700_000_000 + n, 1_700_000_000 + n))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{folder}")


def test_expiry_equals_the_batch(spark, tmp_path):
    at = lambda minutes: (START + timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    event = lambda i, status, minutes: {"id": i, "topic_id": i % 3, "status": status, "at": at(minutes)}
    batches = [
        [event(1, "running", 0), event(2, "running", 1), event(3, "running", 2)],
        [event(2, "completed", 10), event(4, "running", 15)],
        [event(5, "running", 20), event(4, "failed", 29)],
        [event(6, "running", 45)],  # 1 and 3 are past their time
        [event(7, "running", 50), event(6, "completed", 51)],
        [event(8, "running", 80)],  # 5 was due at 50, 7 is due at 80: not past it
    ]
    stream = files(spark, f"{tmp_path}/in", batches, "id long, topic_id long, status string, at timestamp")
    query = finished_runs(stream).writeStream.format("memory").queryName("finished").outputMode("append").option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None
    got = {r["id"]: (r["topic_id"], r["status"], r["error"]) for r in spark.table("finished").collect()}
    assert spark.table("finished").count() == len(got)
    # the ledger as it stands at the end, expired at the last event's time
    last, rows = START + timedelta(minutes=80), {}
    for e in [e for b in batches for e in b]:
        when = datetime.strptime(e["at"], "%Y-%m-%dT%H:%M:%S.%fZ")
        rows[e["id"]] = (e["id"], e["topic_id"], e["status"], rows.get(e["id"], (0, 0, 0, when))[3], "", None, "")
    runs = spark.createDataFrame(list(rows.values()), "id long, topic_id long, status string, started_at timestamp_ntz, stage string, completed_at timestamp_ntz, error string")
    want = {r["id"]: (r["topic_id"], r["status"], r["error"]) for r in ledger.expire_runs(runs, last).filter("status <> 'running'").collect()}
    assert got == want and {i for i, v in got.items() if v[2]} == {1, 3, 5}


def test_fold_upserts_each_batch(spark, tmp_path):
    state = [store.empty_tables(spark)["topics"]]
    seen = []

    def save(df, n):
        rows = df.collect()
        state[0] = spark.createDataFrame(rows, df.schema)
        seen.append(n)

    batches = [[{"slug": "a", "name": "a"}, {"slug": "b", "name": "B"}], [{"slug": "a", "name": "A"}], [{"slug": "c", "name": "C"}]]
    stream = files(spark, f"{tmp_path}/in", batches, "slug string, name string")
    step = lambda topics, batch: catalog.ensure_topics(topics, batch, START)
    query = fold(stream, lambda: state[0], step, save).option("checkpointLocation", f"file://{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(180)
    assert query.exception() is None and seen == [0, 1, 2]
    assert [(r["id"], r["slug"], r["name"]) for r in state[0].orderBy(F.col("id")).collect()] == [(1, "a", "A"), (2, "b", "B"), (3, "c", "C")]
