"""Which requests the limits let through, for whole ledgers at once.

`admitted` applies a cap a day to a queue, first come first served. `replay` applies a least interval
between admitted requests, where each decision depends on the last one that was admitted.

The replay cuts time into blocks no shorter than the interval. A block's requests, whatever was
admitted before, can only be entered at a time within the first interval of the block, and from each
such entry the admitted ones follow by "the first one no sooner than the interval after the last".
So every block, on its own, gives a step function from the time from which a request is admissible on
entry to that on leaving. These functions, one short row a block, are applied in order; then each block
knows its entry and marks what it admits. No task holds more than one block's different times, or one
key's blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def admitted(queue: DataFrame, used: DataFrame, limit: int, by: list[str], order: list[str]) -> DataFrame:
    """queue with place (first come first served among those with equal `by`) and admitted: whether the
    place is within limit less n_runs, of used (by, n_runs). A limit below 1 lets nobody through."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    left = F.lit(limit) - F.coalesce("n_runs", F.lit(0))
    return queue.withColumn("place", place).join(used.select(*by, "n_runs"), by, "left").withColumn("admitted", F.col("place") <= left).drop("n_runs")


def by_group(rows: DataFrame, keys: list[str], order: str, fold: Callable[[dict[str, np.ndarray]], Iterator[tuple]], schema: str) -> DataFrame:
    """The rows that fold makes of each group's columns, in order. The groups of a task follow one another
    sorted, so that many small ones cost no more than a large one; a task holds one group and one batch.

    The places come from a window, as it demands that a group is whole in its task. A repartition by the
    keys demands nothing: after a join by the same keys it is left out, and where the join turns out to be
    a broadcast one at run time, its input is then read by map outputs and the groups are torn."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: pd.DataFrame | None = None

        def folded(b: pd.DataFrame, edges: np.ndarray) -> pd.DataFrame:
            columns = {c: b[c].to_numpy() for c in b.columns}
            out = [r for lo, hi in zip(edges[:-1], edges[1:], strict=True) for r in fold({c: v[lo:hi] for c, v in columns.items()})]
            return pd.DataFrame(out, columns=names)

        for b in batches:
            b = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if len(b):
                edges = np.flatnonzero(b["_place"].to_numpy() == 1)
                if len(edges) > 1:
                    yield folded(b, edges)
                rest = b.iloc[edges[-1] :]  # its group may go on
        if rest is not None and len(rest):
            yield folded(rest, np.array([0, len(rest)]))

    return rows.withColumn("_place", place).mapInPandas(run, schema)


def _next(times: np.ndarray, interval: int) -> np.ndarray:
    """Of each time the place of the first one no sooner than interval later."""
    return np.searchsorted(times, times + interval, side="left")


def block_exits(times: np.ndarray, entries: int, interval: int) -> np.ndarray:
    """When a request is admissible again after the block, for each of the first `entries` times as the
    first admitted one."""
    follow = _next(times, interval)
    out = np.empty(len(times), np.int64)
    for i in range(len(times) - 1, -1, -1):
        out[i] = times[i] + interval if follow[i] == len(times) else out[follow[i]]
    return out[:entries]


def block_admits(times: np.ndarray, since: int, interval: int) -> list[int]:
    """The places of the admitted times of a block in which a request is admissible from `since` on."""
    follow, at, out = _next(times, interval), int(np.searchsorted(times, since, side="left")), []
    while at < len(times):
        out.append(at)
        at = int(follow[at])
    return out


def replay(requests: DataFrame, interval: timedelta, by: list[str] | None = None, at: str = "started_at", id: str = "id", block: timedelta | None = None) -> DataFrame:
    """requests with admitted: whether at least `interval` lies between it and the last admitted one
    before it, among those with equal `by`. Of requests at one time the least id comes first; with an
    interval of zero all are admitted. A null time is never admitted, nor admits others."""
    by = by or []
    step = int(interval / timedelta(microseconds=1))
    if step <= 0:
        return requests.withColumn("admitted", F.col(at).isNotNull())
    width = max(step, int((block or 64 * interval) / timedelta(microseconds=1)))
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in by]  # nulls are one key
    key: Column = F.to_json(F.array(*keys)) if by else F.lit("")
    micros = F.unix_micros(F.col(at).cast("timestamp_ltz")) if dict(requests.dtypes)[at] == "timestamp" else F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(at).cast("timestamp_ntz"))
    rows = requests.withColumn("_key", key).withColumn("_at", micros)
    times = rows.filter("_at is not null").groupBy("_key", "_at").agg(F.min(id).alias("_id"))
    times = times.withColumn("_block", F.call_function("div", F.col("_at") - F.pmod("_at", F.lit(width)), F.lit(width)))

    def exits(of: dict[str, np.ndarray]) -> Iterator[tuple]:
        t, key, place = of["_at"], of["_key"][0], int(of["_block"][0])
        # an entry lies within the first interval of the block; any later time is entered as the first after it
        entries = min(len(t), int(np.searchsorted(t, place * width + step, side="left")) + 1)
        leave = block_exits(t, entries, step)
        # entries that leave alike are one step, known by its last time
        last = np.flatnonzero(np.append(leave[1:] != leave[:-1], True))
        yield key, place, t[:entries][last].tolist(), leave[last].tolist()

    steps = by_group(times, ["_key", "_block"], "_at", exits, "_key string, _block long, _upto array<bigint>, _leave array<bigint>")

    def entered(of: dict[str, np.ndarray]) -> Iterator[tuple]:
        since = -(2**62)
        for place, upto, leave in zip(of["_block"], of["_upto"], of["_leave"], strict=True):
            yield of["_key"][0], int(place), since
            at = int(np.searchsorted(np.asarray(upto), since, side="left"))
            if at < len(upto):
                since = int(leave[at])

    since = by_group(steps, ["_key"], "_block", entered, "_key string, _block long, _since long")

    def admits(of: dict[str, np.ndarray]) -> Iterator[tuple]:
        for at in block_admits(of["_at"], int(of["_since"][0]), step):
            yield of["_key"][0], int(of["_at"][at]), int(of["_id"][at])

    hits = by_group(times.join(since, ["_key", "_block"]), ["_key", "_block"], "_at", admits, "_key string, _at long, _id long")
    out = rows.join(hits.withColumnRenamed("_id", "_hit"), ["_key", "_at"], "left")
    return out.select(*requests.columns, F.coalesce(F.col(id) == F.col("_hit"), F.lit(False)).alias("admitted"))
