"""Near-duplicate documents by an LSH forest over MinHash signatures of five-word shingles.

Documents with equal shingle sets are one class, numbered in the order of their least doc_ids. A
signature has 64 values. Each of 21 trees is a sorted order of the signatures, read from a value of
its own on; signatures that share the first three values of an order are a region of it, and one with
too many members is gone into deeper, to 6, 12, 24 and 48 values, so the depth adapts to the region.
The neighbours in a region's order, which share the longest prefixes, are candidates of each other;
so is the member that agrees best with the region's most common values. A region that is too large is
split by a hash for this first look, with some members repeated in each part as bridges.

Candidates are confirmed on the full shingle sets. First the likeliest candidate of each class is
confirmed and components are formed, then its others between components; then the regions are gone
through again, and all members of different components are compared by signature and confirmed in
place, neighbours or not. The members of the regions that are too large for that meet by their rare
shingles instead, which loses none of their pairs and grows with their number and not with its square
where they are less alike than asked (see rare_groups); only if very many documents of different
components share the same rare shingles is that group dealt into blocks, every block held against
every other, but for two blocks of one component. A group gives only the links that join components,
fewer than its members. So a link is lost only if its ends meet in no tree or their signatures agree
in fewer than LEAST values: at a similarity of 0.75 either has a chance below 1 in 50,000. Components
come from alternating large-star and small-star steps on tables in the shared folder; nothing is
collected.

Edge cases: a null, empty or blank text has the empty set and is linked with nothing; under five words
the whole sequence is the one shingle; a null doc_id is linked with nothing and kept; rows that share a
doc_id are one node, linked by any of their texts, and are kept or not together; ties go to the least
doc_id; texts of any length are taken whole; an empty table gives an empty result; other columns are
ignored by near_duplicates, and returned by near_dedup whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, mix64, parallelism, signed, small_batches, stage
from .sharding import numbered

VALUES, TREES, DEPTHS = 64, 21, (3, 6, 12, 24, 48)
WIDTH = 5
#: Members of a region that are compared at once (two blocks of half as many in a larger one), and those repeated in each part of a larger one.
REGION, BRIDGES = 2048, 16
#: How far apart in a region's order neighbours may stand.
NEAREST = 3
#: Values that candidates agree in: 48 on average at a similarity of 0.75, under 30 in one of 2.6 million.
LEAST = 30
#: Parts that the documents of a common shingle are dealt into while shingles are counted.
SALTS = 16
#: Shingles whose sets are held at once while the candidates of a region are confirmed.
SLICE = 4_000_000

_rng = np.random.default_rng(20240801)
_A = _rng.integers(1, 1 << 63, VALUES, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, VALUES, dtype=np.uint64)


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(width, n)
    out = np.full(n - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i]
    return np.unique(mix64(out))


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """(documents, VALUES) of 32 bits; no set may be empty."""
    flat = np.concatenate(sets)
    start = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), VALUES), np.uint32)
    for i in range(VALUES):
        out[:, i] = np.minimum.reduceat(flat * _A[i] + _B[i], start) >> np.uint64(32)
    return out


SIGNED = "doc_id long, n_shingles long, set_key binary, sig binary"


def signatures(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            full = [s for s in sets if len(s)]
            sigs = iter(signature(full) if full else [])
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array([next(sigs).tobytes() if len(s) else None for s in sets], pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return docs.mapInArrow(run, SIGNED)


def _prefixes(depth: int):
    """doc_id, sig, tree (-1: all) to doc_id, tree and the key of the region at this depth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = VALUES // TREES
        for b in batches:
            if not b.num_rows:
                continue
            docs, trees = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
            sig = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint32).reshape(-1, VALUES).astype(np.uint64)
            for t in range(TREES):
                rows = (trees == t) | (trees < 0)
                k = np.full(int(rows.sum()), np.uint64(t * 131 + depth), np.uint64)
                for j in (t * step + np.arange(depth)) % VALUES:
                    k = mix64(k * np.uint64(0x9E3779B97F4A7C15) + sig[rows, j])
                if len(k):
                    yield pa.RecordBatch.from_arrays([pa.array(docs[rows]), pa.array(np.full(len(k), t, np.int32)), pa.array(signed(k))], ["doc_id", "tree", "key"])

    return run


def _agreement(sig: np.ndarray, other: np.ndarray | None = None) -> np.ndarray:
    """How many values agree, for every two signatures of a region, or of one block and another."""
    other = sig if other is None else other
    if len(sig) <= 64 and len(other) <= 64:
        return (sig[:, None] == other[None]).sum(axis=2, dtype=np.int16)
    agree = np.zeros((len(sig), len(other)), np.int16)
    for j in range(VALUES):
        agree += sig[:, None, j] == other[None, :, j]
    return agree


def _neighbours(docs: np.ndarray, sig: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Candidate pairs of one region, sorted by signature, with how many values agree: members near each
    other in the order, so that they share the longest prefixes, and each with the region's hub."""
    m = len(docs)
    every = np.arange(m)
    i = np.concatenate([every[:-d] for d in range(1, min(NEAREST, m - 1) + 1)])
    j = np.concatenate([every[d:] for d in range(1, min(NEAREST, m - 1) + 1)])
    if m > NEAREST + 1:
        order = np.sort(sig, axis=0)  # the most common value of each column
        size = np.ones((m, VALUES), np.int32)
        for k in range(1, m):
            size[k] = np.where(order[k] == order[k - 1], size[k - 1] + 1, 1)
        common = order[size.argmax(axis=0), np.arange(VALUES)]
        hub = int((sig == common).sum(axis=1).argmax())
        i, j = np.concatenate([i, every]), np.concatenate([j, np.full(m, hub)])
    agree = (sig[i] == sig[j]).sum(axis=1)
    ok = (agree >= least) & (docs[i] != docs[j])
    i, j = i[ok], j[ok]
    lo, hi = np.minimum(docs[i], docs[j]), np.maximum(docs[i], docs[j])
    return list(zip(lo.tolist(), hi.tolist(), agree[ok].tolist(), strict=True))


def _compare(least: int):
    """Rows sorted by region and signature to candidate pairs; holds one region at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(out: list[tuple[int, int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["a", "b", "agree"])

        out: list[tuple[int, int, int]] = []
        for _, (sigs, docs) in _grouped(2, batches):
            if len(docs) > 1:
                out += _neighbours(np.array(docs, np.int64), _signed(sigs), least)
            if len(out) > 10_000:
                yield batch(list(dict.fromkeys(out)))
                out = []
        if out:
            yield batch(list(dict.fromkeys(out)))

    return run


def _across(sig: np.ndarray, roots: np.ndarray, sizes: np.ndarray, sides: np.ndarray, least: int, percent: int) -> np.ndarray:
    """Which members are candidates from different components; sizes alone rule some out. Members of
    sides 0 and 1 are two blocks, held only against each other; side -1 is held against itself."""

    def held(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        small, large = np.minimum(sizes[i, None], sizes[None, j]), np.maximum(sizes[i, None], sizes[None, j])
        return (_agreement(sig[i], sig[j]) >= least) & (roots[i, None] != roots[None, j]) & (100 * small >= percent * large)

    if sides[0] < 0:
        every = np.arange(len(sig))
        return held(every, every)
    i, j = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    across = np.zeros((len(sig), len(sig)), bool)
    across[np.ix_(i, j)] = both = held(i, j)
    across[np.ix_(j, i)] = both.T
    return across


def _slices(across: np.ndarray, sizes: np.ndarray, weight: int) -> Iterator[tuple[int, np.ndarray]]:
    """The members that are candidates, in slices of about `weight` shingles that hold every candidate pair."""
    block = np.cumsum(np.where(across.any(axis=1), sizes, 0)) * 2 // weight
    names, block = np.unique(block, return_inverse=True)
    for x in range(len(names)):
        for y in range(x, len(names)):
            both = across[np.ix_(block == x, block == y)]
            inside = np.zeros(len(sizes), bool)
            inside[block == x] |= both.any(axis=1)
            inside[block == y] |= both.any(axis=0)
            if inside.any():
                yield x * len(names) + y, np.nonzero(inside)[0]


def _grouped(width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[list]]]:
    """Rows sorted by their first `width` columns, as (group, the lists of the other columns)."""
    key, held = None, []
    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns)), strict=True):
            if row[:width] != key:
                if held:
                    yield key, [list(c) for c in zip(*held, strict=True)]
                key, held = row[:width], []
            held.append(row[width:])
    if held:
        yield key, [list(c) for c in zip(*held, strict=True)]


def _signed(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), np.uint32).reshape(-1, VALUES)


def _open(least: int, percent: int, weight: int):
    """Regions, or pairs of their blocks, to the members that still have a candidate in another component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (k, p), (docs, roots, sides, ns, sigs) in _grouped(2, batches):
            if len(set(roots)) < 2:
                continue
            d, c, s, n = (np.array(x, np.int64) for x in (docs, roots, sides, ns))
            across = _across(_signed(sigs), c, n, s, least, percent)
            for name, rows in _slices(across, n, weight):
                m = len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, k, np.int64)), pa.array(np.full(m, p, np.int64)), pa.array(np.full(m, name, np.int32)), pa.array(d[rows]), pa.array(c[rows]), pa.array(s[rows])], ["key", "part", "slice", "doc_id", "root", "side"])

    return run


def _joining(least: int, percent: int):
    """Slices with the members' texts to similar pairs that join their components: fewer than members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a text is turned into its set as it comes, so only sets are held
        rows = (pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([shingles(t).tobytes() for t in b.column(b.num_columns - 1).to_pylist()], pa.large_binary())], names=b.schema.names) for b in batches)
        for _, (docs, roots, sides, sigs, held) in _grouped(3, rows):
            n = np.array([len(h) // 8 for h in held])
            label = np.array(roots, np.int64)
            across = _across(_signed(sigs), label, n, np.array(sides), least, percent)
            # the base of a group of copies has the most candidates: taken first, it spares the copies' own pairs
            order = np.argsort(-across.sum(axis=1), kind="stable")
            across, label, n = across[np.ix_(order, order)], label[order], n[order]
            docs, sets = [docs[i] for i in order], [np.frombuffer(held[i], np.uint64) for i in order]
            values, ids = np.unique(np.concatenate(sets), return_inverse=True)
            ids = np.split(ids, np.cumsum(n)[:-1])
            mark, links = np.zeros(len(values), bool), []
            for i in range(len(docs)):
                js = np.nonzero(across[i, i + 1 :] & (label[i + 1 :] != label[i]))[0] + i + 1
                if not len(js):
                    continue
                mark[ids[i]] = True
                both = np.add.reduceat(mark[np.concatenate([ids[j] for j in js])], np.cumsum(n[js]) - n[js], dtype=np.int64)
                mark[ids[i]] = False
                for j in js[100 * both >= percent * (n[i] + n[js] - both)].tolist():
                    if label[j] != label[i]:
                        links.append((docs[i], docs[j]))
                        label[label == label[j]] = label[i]
            if links:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*links, strict=True)], ["a", "b"])

    return run


def _steps(grows: float = 1.05, most: int = 1 << 40) -> list[int]:
    """The least size of each size class."""
    out = [1]
    while out[-1] < most:
        out.append(max(out[-1] + 1, int(out[-1] * grows)))
    return out


SIZES = _steps()


def _shared(a: int, b: int, percent: int) -> int:
    """How many shingles sets of a and b shingles must share."""
    return -(-percent * (a + b) // (100 + percent))


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, root, text to a row for each shingle."""
    for b in batches:
        for doc, root, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            t = signed(shingles(text))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(t), doc, np.int64)), pa.array(np.full(len(t), root, np.int64)), pa.array(t)], ["doc_id", "root", "token"])


def _prefix_keys(percent: int):
    """doc_id, root, n and the live tokens in order to the groups that the document enters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for doc, root, n, live in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                t = np.array(live, np.int64).view(np.uint64)
                least = -(-percent * n // 100)
                own, first, last = (bisect_right(SIZES, x) - 1 for x in (n, least, 100 * n // percent))
                for c in range(first, last + 1):
                    share = _shared(n, max(SIZES[c], least), percent)
                    # those that no other component holds come first in the order, and meet nobody
                    some = len(t) - share + 1
                    if some > 0:
                        lo, hi = min(own, c), max(own, c)
                        k = mix64(t[:some] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(lo * len(SIZES) + hi))
                        out.append((doc, root, own, lo != hi, k))
            if out:
                size = [len(o[4]) for o in out]
                cols = [np.repeat(np.array([o[i] for o in out]), size) for i in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate([o[4] for o in out]))), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.bool_())], ["key", "doc_id", "root", "size", "two"])

    return run


def rare_groups(members: DataFrame, sigs: DataFrame, texts: Callable[[DataFrame], DataFrame], percent: int = 75) -> DataFrame:
    """doc_id and root of members to groups (key, doc_id, root) that hold every similar pair of members of
    different components.

    Shingles are put in one order: first those held by one component only, then by how many members hold
    them. Sets that must share s of their shingles share one of the first n - s + 1 of either (prefix
    filter), and s is known but for the partner's size, so a member enters groups for each size class its
    partner may be of. Members that owe more of their shingles to themselves than a similar pair can
    have enter no group: a family that is less alike than asked makes none, whatever its size. Groups
    with the same members, and those without two components or two sizes to meet, go."""
    held = members.join(texts(members.select("doc_id")), "doc_id").select("doc_id", "root", "text")
    tokens = stage(held.mapInArrow(_tokens, "doc_id long, root long, token long"), "tokens").withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    # a common shingle's documents are counted, and told the count, in SALTS parts
    some = tokens.groupBy("token", "salt").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    live = some.groupBy("token").agg(F.sum("n").alias("df"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.collect_list("salt").alias("salts")).filter("lo <> hi")
    known = live.select("token", "df", F.explode("salts").alias("salt"))
    met = tokens.join(known.hint("merge"), ["token", "salt"]).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("live"))
    rows = members.join(met, "doc_id").join(sigs.select("doc_id", "n"), "doc_id").select("doc_id", "root", "n", F.col("live.token").alias("live"))
    keyed = stage(rows.mapInArrow(_prefix_keys(percent), "key long, doc_id long, root long, size int, two boolean"), "prefixes")
    of_key = keyed.groupBy("key").agg(
        F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("size").alias("small"), F.max("size").alias("large"), F.first("two").alias("two"),
        F.bit_xor(F.xxhash64("doc_id")).alias("x"), F.bit_xor(F.xxhash64("doc_id", F.lit(1))).alias("y"),
    )
    kept = of_key.filter("lo <> hi and (not two or small <> large)").groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key")
    return stage(keyed.join(kept.hint("merge"), "key", "left_semi").select("key", "doc_id", "root"), "rare")


def _mixed(named: DataFrame) -> DataFrame:
    """key and n of the groups with several components."""
    return named.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key", "n")


def _groups(named: DataFrame, sigs: DataFrame, texts: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """The parts (see _blocks) of the regions that are small enough, and of the groups that the members of the others make."""
    mixed = _mixed(named)
    large = stage(named.join(mixed.filter(F.col("n") > REGION), "key", "left_semi").select("doc_id", "root").distinct(), "large")
    small = named.join(mixed.filter(F.col("n") <= REGION), "key", "left_semi").select("key", F.lit(0).cast("long").alias("part"), F.lit(-1).alias("side"), "doc_id", "root")
    if not large.limit(1).count():
        return small
    return small.unionByName(_blocks(rare_groups(large, sigs, texts, percent)))


def _blocks(named: DataFrame) -> DataFrame:
    """key, doc_id and root of groups to key, part, side, doc_id, root: a group of at most REGION members
    is one part; the members of a larger one are dealt into blocks, those of a large component into blocks
    of its own, and a part is one block (side -1) or two (sides 0 and 1). Two of one component make no part."""
    mixed = _mixed(named)
    small = named.join(mixed.filter(F.col("n") <= REGION), "key", "left_semi").select("key", F.lit(0).cast("long").alias("part"), F.lit(-1).alias("side"), "doc_id", "root")
    large = stage(named.join(mixed.filter(F.col("n") > REGION), "key", "left_semi").select("key", "doc_id", "root"), "large")
    if not large.limit(1).count():
        return small
    most = max(1, REGION // 2)
    own = 2 * F.col("m") > most
    sizes = large.groupBy("key", "root").agg(F.count("*").alias("m"))
    rest = sizes.groupBy("key").agg(F.sum(F.when(own, 0).otherwise(F.col("m"))).alias("rest"))
    place = lambda size: F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col(size) / most)))
    block = F.when(own, F.xxhash64("root", place("m"))).otherwise(F.xxhash64(place("rest")))
    members = stage(large.join(sizes, ["key", "root"]).join(rest, "key").select("key", block.alias("block"), "doc_id", "root"), "blocks")
    blocks = members.groupBy("key", "block").agg(F.min("root").alias("lo"), F.max("root").alias("hi"))
    a, b = blocks.toDF("key", "x", "xlo", "xhi"), blocks.toDF("key", "y", "ylo", "yhi")
    pairs = a.join(b, "key").filter("x <= y and not (xlo = xhi and ylo = yhi and xlo = ylo)").withColumn("part", F.xxhash64("x", "y"))
    side = lambda n, c: F.struct(F.lit(n).alias("side"), F.col(c).alias("block"))
    sides = pairs.select("key", "part", F.explode(F.when(F.col("x") == F.col("y"), F.array(side(-1, "x"))).otherwise(F.array(side(0, "x"), side(1, "y")))).alias("e")).select("key", "part", "e.*")
    return small.unionByName(members.join(sides, ["key", "block"]).select("key", "part", "side", "doc_id", "root"))


def links_between(regions: DataFrame, sigs: DataFrame, roots: DataFrame, texts: Callable[[DataFrame], DataFrame], percent: int = 75, least: int = LEAST, weight: int = SLICE) -> DataFrame:
    """Links a, b between components: every candidate pair of a region is confirmed on full sets unless
    links found before already join its ends, so a part gives fewer links than it has members. texts: the
    texts (doc_id, text) of given doc_ids."""
    parts = parallelism(sigs.sparkSession)
    named = regions.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
    rows = _groups(named, sigs, texts, percent).join(sigs, "doc_id").select("key", "part", "doc_id", "root", "side", "n", "sig")
    rows = rows.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "doc_id")
    members = stage(rows.mapInArrow(_open(least, percent, weight), "key long, part long, slice int, doc_id long, root long, side long"), "open")
    full = members.join(sigs, "doc_id").join(texts(members.select("doc_id").distinct()), "doc_id").select("key", "part", "slice", "doc_id", "root", "side", "sig", "text")
    full = full.repartition(parts, "key", "part", "slice").sortWithinPartitions("key", "part", "slice", "doc_id")
    return stage(full.mapInArrow(_joining(least, percent), "a long, b long"), "joining")


def candidate_pairs(sigs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """a < b and agree for the neighbours in some tree's order, and the regions (key, doc_id and n, its
    members) of the first depth, which hold all deeper ones."""
    spark = sigs.sparkSession
    parts = parallelism(spark)
    sigs = sigs.select("doc_id", "sig")
    rows, pairs, regions = sigs.withColumn("tree", F.lit(-1)), None, None
    for depth in DEPTHS:
        keyed = rows.mapInArrow(_prefixes(depth), "doc_id long, tree int, key long")
        counts = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
        met = stage(keyed.join(counts, "key"), f"depth{depth}")
        split = F.ceil(F.col("n") / REGION).cast("int")
        part = F.pmod(F.xxhash64("doc_id", "tree"), split).cast("int")
        bridge = F.pmod(F.xxhash64("doc_id"), F.greatest(F.lit(1), (F.col("n") / BRIDGES).cast("int"))) == 0
        dealt = met.withColumn("part", F.explode(F.when((split > 1) & bridge, F.sequence(F.lit(0), split - 1)).otherwise(F.array(part))))
        if regions is None:
            regions = met.select("key", "doc_id", "n")
        first = F.col("tree") * (4 * (VALUES // TREES)) + 1  # a tree's order is the signature's, read from its own value on
        order = F.concat(F.substr("sig", first), F.substr("sig", F.lit(1), first - 1)).alias("order")
        dealt = dealt.join(sigs, "doc_id").select("key", "part", order, "doc_id")
        found = dealt.repartition(parts, "key", "part").sortWithinPartitions("key", "part", "order", "doc_id").mapInArrow(_compare(least), "a long, b long, agree int")
        pairs = found if pairs is None else pairs.unionByName(found)
        deeper = met.filter(F.col("n") > REGION).select("doc_id", "tree")
        if depth == DEPTHS[-1] or not deeper.limit(1).count():
            break
        rows = deeper.join(sigs, "doc_id").select("doc_id", "sig", "tree")
    return stage(pairs.groupBy("a", "b").agg(F.max("agree").alias("agree")), "pairs"), regions


def _confirm(percent: int):
    """Rows sorted by group with the leader first: pairs whose sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, own = None, np.zeros(0, np.uint64)
        for b in batches:
            out: list[tuple[int, int]] = []
            for a, _, role, doc, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if role == 0:
                    if doc != leader:
                        leader, own = doc, shingles(text)
                    continue
                if a == leader:
                    s = shingles(text)
                    both = len(np.intersect1d(own, s, assume_unique=True))
                    if 100 * both >= percent * (len(own) + len(s) - both):
                        out.append((a, doc))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int = 75, group: int = 32) -> DataFrame:
    """The pairs whose full sets are similar enough. Pairs are grouped by their first document, in
    parts of about `group`, so its text travels once for each part and no part is large."""
    parts = parallelism(pairs.sparkSession)
    many = pairs.groupBy("a").agg(F.count("*").alias("n"))
    dealt = pairs.join(many, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / group)).cast("int"))
    asked = dealt.select("a", "part", F.lit(1).alias("role"), F.col("b").alias("doc_id")).unionByName(dealt.select("a", "part", F.lit(0).alias("role"), F.col("a").alias("doc_id")).distinct())
    rows = asked.join(texts, "doc_id").select("a", "part", "role", "doc_id", "text")
    return stage(rows.repartition(parts, "a", "part").sortWithinPartitions("a", "part", "role").mapInArrow(_confirm(percent), "a long, b long"), "links")


def components(links: DataFrame) -> DataFrame:
    """node, root for every node of links (a, b); root is the least node that can be reached."""
    edges = stage(links.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(low, "a").filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = stage(small, "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = now


def _same_set(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows doc_id, number, set_key, sole, text those whose text has this set; sole: no other text can come."""
    for b in batches:
        ok = [sole or xxhash.xxh3_128_digest(shingles(t).tobytes()) == k for k, sole, t in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
        kept = b.filter(pa.array(ok, pa.bool_()))
        yield pa.RecordBatch.from_arrays([kept.column(i) for i in (0, 1, 4)], ["id", "doc_id", "text"])


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each row of docs."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    all_sigs = stage(signatures(slim), "signatures")
    usable = all_sigs.filter("doc_id is not null and n_shingles > 0")
    classes, _ = numbered(usable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n")), ["rep", "set_key"])
    number = F.col("row_no").alias("doc_id")  # from here on classes go by their numbers
    sigs = classes.select(number, "sig", "n")
    # texts under one doc_id are linked by it
    own = usable.select("doc_id", "set_key").distinct()
    clash = stage(own.join(own.groupBy("doc_id").agg(F.min("set_key").alias("lo"), F.max("set_key").alias("hi")).filter("lo <> hi").select("doc_id", "lo"), "doc_id").filter("set_key <> lo"), "clash")
    numbers = classes.select("set_key", "row_no")
    by_id = clash.join(numbers.toDF("set_key", "a"), "set_key").join(numbers.toDF("lo", "b"), "lo").select("a", "b")

    def texts(ids: DataFrame) -> DataFrame:
        several = clash.select(F.col("doc_id").alias("rep")).distinct().withColumn("_s", F.lit(True))
        # merged at every size: the ids have no bound that a broadcast could rely on
        wanted = classes.select(number, "rep", "set_key").join(ids.hint("merge"), "doc_id").join(several, "rep", "left").select(F.col("rep").alias("id"), "doc_id", "set_key", F.col("_s").isNull().alias("sole"))
        met = wanted.hint("merge").join(slim.withColumnRenamed("doc_id", "id"), "id").select("id", "doc_id", "set_key", "sole", "text")
        return met.mapInArrow(_same_set, "id long, doc_id long, text string").dropDuplicates(["id", "doc_id"]).select("doc_id", "text")

    pairs, regions = candidate_pairs(sigs)
    ends = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).distinct()
    held = stage(texts(ends), "texts")
    ordered = F.struct(F.col("agree"), (-F.col("other")).alias("other"))
    sided = pairs.select(F.col("a").alias("u"), F.col("b").alias("other"), "agree").unionByName(pairs.select(F.col("b").alias("u"), F.col("a").alias("other"), "agree"))
    best = sided.groupBy("u").agg(F.max(ordered).alias("x")).select(F.least("u", -F.col("x.other")).alias("a"), F.greatest("u", -F.col("x.other")).alias("b")).distinct()
    roots = components(confirmed(best, held, percent).unionByName(by_id))
    named = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left").join(roots.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
    second = stage(named.filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b").join(best, ["a", "b"], "left_anti"), "second")
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(confirmed(second, held, percent)))
    more = links_between(regions, sigs, roots, texts, percent)
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    # numbers ascend with the least doc_ids, so a component's least number has its least doc_id
    least = classes.select(F.col("row_no").alias("root"), F.col("rep").alias("component"))
    joined = classes.select("set_key", "row_no").join(roots, classes["row_no"] == roots["node"], "left").select("set_key", F.coalesce("root", "row_no").alias("root"))
    of_class = joined.join(least, "root").select("set_key", "component")
    component = F.coalesce("component", "doc_id")
    return all_sigs.join(of_class, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, percent: int = 75) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    name = free_name(docs, "_gone")
    gone = near_duplicates(docs, percent).filter("not kept").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(name), "left_anti")
