"""Exact integer centroid clustering with Hamerly's bounds.

Components become integers, floor(scale * x). Each vector carries its cluster, an upper bound of the
distance to that cluster's centroid and a lower bound of the distance to the second nearest one. When
the centroids have moved, the upper bound grows by the drift of the vector's own centroid and the lower
bound shrinks by the greatest drift of any other. While the upper bound is below the lower one the
vector's cluster can't have changed. Otherwise the distance to its own centroid is computed; if that
doesn't settle it, the vector is ambiguous and is held against all centroids in whole numbers, which
gives its cluster (the smaller number of equals) and both bounds anew. Bounds are widened by more than
floating point can err, so they never settle what whole numbers wouldn't.

Vectors and bounds are one written table a round, read by the next; no row is shuffled. A round's sums
are formed in each task, one row a cluster, before they are added up; the driver sees one row a
cluster, and divides by whole numbers.

Edge cases: a vector that is null, of another length, or has a null or non-finite component is left
out; a null vec_id counts as the empty string where ids are hashed; vec_ids that occur more than once
are clustered each, and where seeds tie by id they are taken in the order of their bytes; fewer
vectors than clusters give as many clusters as vectors; equal seeds leave the greater number empty; an
empty table gives an empty result; other columns are ignored. A component whose integer exceeds 2**27
raises: its distance wouldn't fit a long.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, scratch, stage

#: Integers beyond it could give distances beyond a long.
LARGEST = 1 << 27
#: Relative room for the rounding of square roots and sums.
ROOM = 1e-9
STATE = "vec_id long, v binary, cluster int, upper double, lower double, scanned boolean"


def integers(vectors: DataFrame, width: int = 64, scale: int = 256) -> DataFrame:
    """vec_id and v, the integers as little-endian 32-bit bytes, of the vectors that count."""
    e = F.col("embedding")
    sound = (F.size(e) == width) & F.forall(e, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    kept = vectors.filter(F.coalesce(e.isNotNull() & sound, F.lit(False)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            x = np.floor(scale * lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(-1, width)
            if len(x) and np.abs(x).max() > LARGEST:
                raise ValueError(f"a component is beyond {LARGEST} after scaling")
            rows = x.astype("<i4")
            yield pa.RecordBatch.from_arrays([b.column(0), _binary(rows)], ["vec_id", "v"])

    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), e.cast("array<double>").alias("e")).mapInArrow(run, "vec_id long, v binary")


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes as one value."""
    n, size = len(rows), rows.shape[1] * rows.itemsize
    offsets = np.arange(n + 1, dtype=np.int32) * size
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(rows))])


def _rows(values: pa.Array, width: int) -> np.ndarray:
    if not len(values):
        return np.zeros((0, width), np.int64)
    raw = values.cast(pa.binary())
    start = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset]
    return np.frombuffer(raw.buffers()[2], "<i4", len(raw) * width, int(start)).reshape(-1, width).astype(np.int64)


def seeds(rows: DataFrame, clusters: int, salt: int = 2) -> list[list[int]]:
    """The first centroids: the vectors with the least sha256 of '<salt>:<vec_id>'."""
    name = F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    best = rows.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(clusters)
    return [np.frombuffer(r["v"], "<i4").tolist() for r in sorted(best.collect(), key=lambda r: (r["h"], bytes(r["v"])))]


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, (vectors, centroids). Where all products fit a double's whole numbers they
    are formed by a matrix product of doubles, which is exact there."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * x.shape[1] * most * most < 1 << 53:
        f, c = x.astype(np.float64), centroids.astype(np.float64)
        return ((f * f).sum(axis=1)[:, None] - 2 * (f @ c.T) + (c * c).sum(axis=1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)


def own_distances(x: np.ndarray, centroids: np.ndarray, cluster: np.ndarray) -> np.ndarray:
    return ((x - centroids[cluster]) ** 2).sum(axis=1)


def scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each vector's nearest centroid and both bounds."""
    d = distances(x, centroids)
    cluster = d.argmin(axis=1)  # the first of equals
    near = d[np.arange(len(x)), cluster]
    if len(centroids) > 1:
        d[np.arange(len(x)), cluster] = np.iinfo(np.int64).max
        second = np.sqrt(d.min(axis=1).astype(np.float64)) * (1 - ROOM)
    else:
        second = np.full(len(x), np.inf)
    return cluster, np.sqrt(near.astype(np.float64)) * (1 + ROOM), second


def reassign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray, drift: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Clusters and bounds after the centroids moved by drift, and which vectors were scanned."""
    order = np.argsort(drift)
    # the greatest drift of any centroid but the vector's own
    others = np.full(len(drift), drift[order[-1]])
    others[order[-1]] = drift[order[-2]] if len(drift) > 1 else 0.0
    upper = (upper + drift[cluster]) * (1 + ROOM)
    lower = lower - others[cluster] - ROOM * (np.where(np.isfinite(lower), np.abs(lower), 0) + others[cluster])
    unsure = np.flatnonzero(upper >= lower)
    if len(unsure):
        upper[unsure] = np.sqrt(own_distances(x[unsure], centroids, cluster[unsure]).astype(np.float64)) * (1 + ROOM)
        unsure = unsure[upper[unsure] >= lower[unsure]]
    scanned = np.zeros(len(x), bool)
    if len(unsure):
        cluster = cluster.copy()
        cluster[unsure], upper[unsure], lower[unsure] = scan(x[unsure], centroids)
        scanned[unsure] = True
    return cluster, upper, lower, scanned


def _drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    return np.sqrt(((new - old) ** 2).sum(axis=1).astype(np.float64)) * (1 + ROOM)


def assigned(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """state after an assignment; before: the centroids of the assignment before, None at the first."""
    width = centroids.shape[1]
    drift = None if before is None else _drift(before, centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b.column(1), width)
            if drift is None:
                cluster, upper, lower = scan(x, centroids)
                scanned = np.ones(len(x), bool)
            else:
                held = [b.column(i).to_numpy(zero_copy_only=False) for i in (2, 3, 4)]
                cluster, upper, lower, scanned = reassign(x, held[0].astype(np.int64), held[1].astype(float), held[2].astype(float), centroids, drift)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster, pa.int32()), pa.array(upper), pa.array(lower), pa.array(scanned)], ["vec_id", "v", "cluster", "upper", "lower", "scanned"])

    return state.mapInArrow(run, STATE)


def moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids' exact floored means; an empty one stays."""
    k, width = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, count = np.zeros((k, width), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, cluster = _rows(b.column(0), width), b.column(1).to_numpy()
            order = np.argsort(cluster, kind="stable")
            present, start = np.unique(cluster[order], return_index=True)
            if len(present):
                sums[present] += np.add.reduceat(x[order], start, axis=0)
                count += np.bincount(cluster, minlength=k)
        rows = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(count[rows]), pa.array(sums[rows].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = state.select("v", "cluster").mapInArrow(run, "cluster int, n long, sums array<bigint>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)])
    out = centroids.copy()
    for r in total.collect():  # one row a cluster
        out[r["cluster"]] = [r[f"s{j}"] // r["n"] for j in range(width)]
    return out


def cluster_vectors(vectors: DataFrame, clusters: int = 40, rounds: int = 5, width: int = 64, scale: int = 256, salt: int = 2) -> DataFrame:
    """vec_id, cluster, its squared distance, the sums of distances, and the centroid's digest for each vector."""
    spark = vectors.sparkSession
    rows = stage(integers(vectors, width, scale), "vectors")
    first = seeds(rows, clusters, salt)
    result = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], result)
    centroids, before = np.array(first, np.int64), None
    state = rows.select("vec_id", "v", *[F.lit(None).cast(t).alias(n) for n, t in (f.split() for f in STATE.split(", ")[2:])])
    held = None
    for _ in range(rounds):
        path = scratch(spark, "bounds")
        assigned(state, centroids, before).write.parquet(path)
        state = spark.read.schema(STATE).parquet(path)
        if held:
            discard(spark, held)  # the round before it isn't read again
        held = path
        before, centroids = centroids, moved(state, centroids)
    last = assigned(state, centroids, before)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cluster = b.column(2)
            d = own_distances(_rows(b.column(1), width), centroids, cluster.to_numpy().astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), cluster, pa.array(d, pa.int64())], ["vec_id", "cluster", "distance"])

    done = stage(last.mapInArrow(run, "vec_id long, cluster int, distance long"), "clusters")
    sums = {r["cluster"]: r["s"] for r in done.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row a cluster
    own = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    facts = spark.createDataFrame(own, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return done.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
