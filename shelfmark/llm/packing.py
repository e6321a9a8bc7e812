"""Shortest-pack-first packing of token sequences over the histogram of their lengths.

Documents are cut at multiples of the sequence length; the pieces' lengths make a histogram of at
most max_len bins, the only thing the driver sees. Lengths are placed longest first into the packs
with the most room; equal packs are one pattern with a count. A piece then finds its pack by its
rank among the pieces of its length. Ranks come from salted groups, so a length that a third of all
pieces share is ranked by many tasks.

Edge cases: a null or empty text is one piece that holds the end id alone; repeated rows, and rows
that share a doc_id, are packed each; ties are broken by doc_id, start and the ids' checksum; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import parallelism, small_batches, stage
from .tokens import tokenizer, vocabulary

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long"


def pack_histogram(histogram: dict[int, int], max_len: int) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns as (how many packs, lengths in order). Every piece of the histogram is in one pack.

    Where no open pack has room for the rest of a bin, just as many packs are opened as these pieces
    fill, so equal short pieces don't get a pack each.
    """
    open_packs: list[tuple[int, int, int, tuple[int, ...]]] = []  # (-room, age, packs, lengths)
    full: list[tuple[int, tuple[int, ...]]] = []
    age = 0
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            if open_packs and -open_packs[0][0] >= length:
                room, _, packs, lengths = heapq.heappop(open_packs)
                room = -room
            else:
                packs, lengths, room = -(-left // (max_len // length)), (), max_len
            used = min(packs, left)
            left -= used
            if used < packs and lengths:
                age += 1
                heapq.heappush(open_packs, (-room, age, packs - used, lengths))
            if room == length:
                full.append((used, (*lengths, length)))
            else:
                age += 1
                heapq.heappush(open_packs, (length - room, age, used, (*lengths, length)))
    return full + [(packs, lengths) for _, _, packs, lengths in sorted(open_packs)]


def pieces(docs: DataFrame, vocab: str, end_id: int, max_len: int) -> DataFrame:
    """A row for each piece of each document."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, end = tokenizer(vocab), int(end_id).to_bytes(4, "little")
        for b in batches:
            out: list[list[int]] = [[], [], [], [], []]
            keys = b.column(0).to_pylist()
            for key, ids in zip(keys, tok.ids(b.column(1).to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                for start in range(0, n, max_len):
                    piece = ids[4 * start : 4 * (start + max_len)]
                    for col, v in zip(out, (key, start, len(piece) // 4, zlib.crc32(piece), n), strict=True):
                        col.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def _salt(spark: SparkSession, x: Column) -> Column:
    return F.pmod(x, F.lit(parallelism(spark))).cast("int")


def pack(parts: DataFrame, max_len: int) -> DataFrame:
    """Adds sequence_id and offset to rows that have a length of at most max_len."""
    ties = [c for c in ("doc_id", "start", "ids_crc32", "doc_tokens") if c in parts.columns]
    salted = parts if "_salt" in parts.columns else parts.withColumn("_salt", _salt(parts.sparkSession, F.xxhash64(*ties)))
    counts = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    by_salt = Window.partitionBy("length").orderBy("_salt")
    before = counts.withColumn("_before", F.sum("_n").over(by_salt) - F.col("_n")).drop("_n")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}  # max_len rows at most
    own = Window.partitionBy("length", "_salt").orderBy(*ties)  # rows that are equal in all of these may change places
    ranked = salted.withColumn("_own", F.row_number().over(own) - 1).join(before, ["length", "_salt"])
    ranked = ranked.withColumn("_rank", F.col("_before") + F.col("_own")).drop("_before", "_own", "_salt")

    slot: dict[int, list[tuple[int, int, int]]] = {}
    taken: dict[int, int] = dict.fromkeys(histogram, 0)
    base = 0
    for packs, lengths in pack_histogram(histogram, max_len):
        at = 0
        for n in lengths:
            slot.setdefault(n, []).append((taken[n], base, at))
            taken[n] += packs
            at += n
        base += packs
    places = {n: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for n, rows in slot.items()}
    names = [c for c in ranked.columns if c != "_rank"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                first, base, at = places[int(n)]
                rows = length == n
                k = np.searchsorted(first, rank[rows], "right") - 1
                seq[rows], off[rows] = base[k] + rank[rows] - first[k], at[k]
            kept = [b.column(b.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in ranked.select(names).dtypes)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, vocab: str | None = None, end_id: int = 1, max_len: int = 2048) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    small_batches(docs.sparkSession)
    rows = pieces(docs, vocab or vocabulary("byte_bpe_50k.json"), end_id, max_len)
    # the row's place is part of the salt, so that copies under one doc_id spread too; it is written with the rows
    parts = stage(rows.withColumn("_salt", _salt(docs.sparkSession, F.xxhash64("doc_id", "start", F.monotonically_increasing_id()))), "pieces")
    return pack(parts, max_len).select("doc_id", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "doc_tokens", "sequence_id", "offset")
