"""Token ids in files of patched frame-of-reference blocks.

A block holds 256 ids: their minimum, a width that covers a given share of the differences, these
packed at that width, and the outliers' high parts as a list of exceptions. Each file starts with
the documents' ids and lengths and the byte offset of every block, so a reader can decode any range.
Files are written in ascending doc_id order: one or more for each range partition, named by
partition and segment.

Layout, little-endian: magic PFR1; u32 block size; u64 ids; u32 documents; u32 blocks; i64 doc_id
each; u32 length each; u64 block start each (from the file's start); blocks: u32 minimum, u8 width,
u16 exceptions, packed bits, u8 position each, u32 high part each.

Edge cases: a null or empty text has the end id alone; null doc_ids come first and are written as
the least 64-bit integer; rows that share a doc_id are written each, ordered by the hash of their
text and then the text; an empty table writes no file; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, scratch, small_batches, stage
from .tokens import tokenizer, vocabulary

BLOCK = 256
HEAD = struct.Struct("<4sIQII")
NO_ID = -(1 << 63)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(k, BLOCK) values below 2**width to (k, BLOCK * width / 8) bytes."""
    bits = ((values[:, :, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return np.packbits(bits.reshape(len(values), -1), axis=1, bitorder="little")


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(packed), BLOCK, width)
    out = np.zeros((len(packed), BLOCK), np.uint32)
    for i in range(width):
        out |= bits[:, :, i].astype(np.uint32) << np.uint32(i)
    return out


def encode_file(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, cover: float = 0.9, chunk: int = 2048) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.empty(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    padded[n:] = ids[-1] if n else 0
    parts: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    rank = min(BLOCK - 1, int(np.ceil(cover * BLOCK)) - 1)
    for at in range(0, blocks, chunk):
        m = padded[at * BLOCK : (at + chunk) * BLOCK].reshape(-1, BLOCK)
        low = m.min(axis=1)
        d = m - low[:, None]
        width = np.ceil(np.log2(np.partition(d, rank, axis=1)[:, rank].astype(np.float64) + 1)).astype(np.uint32)
        high = d >> width[:, None]
        row, pos = np.nonzero(high)
        exceptions = np.bincount(row, minlength=len(m))
        size = 7 + (BLOCK // 8) * width.astype(np.int64) + 5 * exceptions
        start = np.cumsum(size) - size
        buf = np.zeros(int(size.sum()), np.uint8)
        buf[start[:, None] + np.arange(4)] = low.astype("<u4").view(np.uint8).reshape(-1, 4)
        buf[start + 4] = width
        buf[start[:, None] + 5 + np.arange(2)] = exceptions.astype("<u2").view(np.uint8).reshape(-1, 2)
        for w in np.unique(width):
            if w:
                rows = np.flatnonzero(width == w)
                packed = _pack(d[rows] & np.uint32((1 << int(w)) - 1), int(w))
                buf[start[rows][:, None] + 7 + np.arange(packed.shape[1])] = packed
        if len(row):
            tail = start[row] + 7 + (BLOCK // 8) * width[row].astype(np.int64)
            k = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
            buf[tail + k] = pos
            buf[(tail + exceptions[row] + 4 * k)[:, None] + np.arange(4)] = high[row, pos].astype("<u4").view(np.uint8).reshape(-1, 4)
        parts.append(buf)
        sizes.append(size)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    first = HEAD.size + 12 * len(doc_ids) + 8 * blocks
    head = HEAD.pack(b"PFR1", BLOCK, n, len(doc_ids), blocks)
    return b"".join([head, doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(), (first + np.cumsum(size) - size).astype("<u8").tobytes(), *(p.tobytes() for p in parts)])


def read_index(data: bytes | memoryview) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """doc_ids, lengths, block starts, number of ids."""
    magic, block, n, docs, blocks = HEAD.unpack_from(data)
    if magic != b"PFR1" or block != BLOCK:
        raise ValueError("not a PFR1 file")
    at = HEAD.size
    return np.frombuffer(data, "<i8", docs, at), np.frombuffer(data, "<u4", docs, at + 8 * docs), np.frombuffer(data, "<u8", blocks, at + 12 * docs).astype(np.int64), n


def decode_blocks(data: bytes | memoryview, starts: np.ndarray, first: int, last: int) -> np.ndarray:
    """The ids of blocks first to last - 1."""
    buf = np.frombuffer(data, np.uint8)
    start = starts[first:last]
    low = np.ascontiguousarray(buf[start[:, None] + np.arange(4)]).view("<u4").ravel()
    width = buf[start + 4].astype(np.int64)
    exceptions = np.ascontiguousarray(buf[start[:, None] + 5 + np.arange(2)]).view("<u2").ravel().astype(np.int64)
    out = np.zeros((len(start), BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            rows = np.flatnonzero(width == w)
            out[rows] = _unpack(buf[start[rows][:, None] + 7 + np.arange(BLOCK // 8 * w)], int(w))
    row = np.repeat(np.arange(len(start)), exceptions)
    if len(row):
        tail = start[row] + 7 + (BLOCK // 8) * width[row]
        k = np.arange(len(row)) - (np.cumsum(exceptions) - exceptions)[row]
        high = np.ascontiguousarray(buf[(tail + exceptions[row] + 4 * k)[:, None] + np.arange(4)]).view("<u4").ravel()
        out[row, buf[tail + k]] |= high << width[row].astype(np.uint32)
    return (out + low[:, None]).ravel()


def decode_file(data: bytes | memoryview, chunk: int = 2048) -> Iterator[tuple[int, np.ndarray]]:
    """(doc_id, ids) in file order, a few blocks at a time."""
    doc_ids, lengths, starts, n = read_index(data)
    have, block, left = np.zeros(0, np.uint32), 0, n
    for key, length in zip(doc_ids.tolist(), lengths.tolist(), strict=True):
        more = [have]
        size = len(have)
        while size < length:
            ids = decode_blocks(data, starts, block, min(block + chunk, len(starts)))[:left]
            block, left, size = block + chunk, left - len(ids), size + len(ids)
            more.append(ids)
        have = np.concatenate(more) if len(more) > 1 else have
        yield key, have[:length]
        have = have[length:]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(docs: DataFrame, path: str, vocab: str, end_id: int, segment: int = 8 << 20) -> DataFrame:
    """Write the files; returns part, segment, file, n_docs, n_tokens for each. path must be on storage
    that all executors share. Each attempt of a task gives its files names of their own, so a repeated task
    meets nothing of a lost one; only the files that the rows name count."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tok, end, part, number = tokenizer(vocab), int(end_id).to_bytes(4, "little"), TaskContext.get().partitionId(), 0
        where, root = _open(path)
        keys: list[int] = []
        blobs: list[bytes] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name = f"{part:06d}-{number:06d}-{uuid.uuid4().hex}.pfr"
            data = encode_file(np.array(keys, np.int64), np.array([len(x) // 4 for x in blobs], np.uint32), np.frombuffer(b"".join(blobs), "<u4"))
            where.create_dir(root, recursive=True)
            with where.open_output_stream(f"{root}/{name}") as f:
                f.write(data)
            row = [[part], [number], [name], [len(keys)], [size]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "segment", "file", "n_docs", "n_tokens"])

        for b in batches:
            for key, ids in zip(b.column(0).to_pylist(), tok.ids(b.column(1).to_pylist()), strict=True):
                keys.append(NO_ID if key is None else key)
                blobs.append(ids + end)
                size += len(ids) // 4 + 1
                if size >= segment:
                    yield flush()
                    keys, blobs, size, number = [], [], 0, number + 1
        if keys:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    rows = rows.withColumn("_hash", F.xxhash64("text")).withColumn("_tie", F.monotonically_increasing_id())
    dealt = rows.repartitionByRange(parallelism(docs.sparkSession), "doc_id", "_hash", "_tie").sortWithinPartitions("doc_id", "_hash", "text", "_tie").select("doc_id", "text")
    return stage(dealt.mapInArrow(write, "part int, segment int, file string, n_docs long, n_tokens long"), "files")


def read_tokens(files: DataFrame, path: str) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32 for each document."""
    spark, total = files.sparkSession, 0
    offsets = []
    for part, n in sorted(files.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):  # a row a partition
        offsets.append((part, total))
        total += n
    order = Window.partitionBy("part").orderBy("segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    located = files.join(F.broadcast(spark.createDataFrame(offsets, "part int, _first long")), "part").select("file", (F.col("_first") + F.sum("n_tokens").over(order) - F.col("n_tokens")).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = _open(path)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with where.open_input_stream(f"{root}/{name}") as f:
                    data = f.read()
                rows: list[tuple] = []
                for key, ids in decode_file(data):
                    rows.append((None if key == NO_ID else key, start, len(ids), zlib.crc32(np.ascontiguousarray(ids, "<u4"))))
                    start += len(ids)
                cols = list(zip(*rows, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return located.repartition(parallelism(files.sparkSession), "file").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def binary_output(docs: DataFrame, path: str | None = None, vocab: str | None = None, end_id: int = 2) -> DataFrame:
    """Write docs' ids below path (default: the shared scratch folder) and read them back."""
    small_batches(docs.sparkSession)
    path = path or scratch(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, path, vocab or vocabulary("word_bpe_49k.json"), end_id), path)
