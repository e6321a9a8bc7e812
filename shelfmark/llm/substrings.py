"""Exact removal of 50-byte strings that also start in an earlier document, by bucket-pointer refinement.

Positions begin in buckets of 20 bytes (q-grams), known by a hash. Of these only the buckets least in
some 50-byte window are kept (a window picks the same one wherever it stands), a sixteenth of all
positions; buckets with a single document end there. The positions left are sent, with the 30 bytes on
either side, to the task of their bucket, and from here on only bytes decide. Members whose whole
surroundings are equal are one class, and all but its earliest document's lose all 31 windows around
the position. Of the classes one member each is refined window by window: initial buckets of 8 bytes
get pointers in their sorted order, then the members of each bucket with several are sorted on the
bucket pointers of the positions 8, 16 and 18 bytes later, which splits the bucket and updates its
pointers, and the updated pointers serve the next round, until a bucket is 50 equal bytes.

Steps, each a shuffle of packed blocks: buckets to their documents; documents back with the buckets
that repeat; surroundings by bucket; documents back with the windows that go. Whole copies of an
earlier text are settled before by their digest. A bucket that repeats among the texts of one block is
known to repeat there, and two of its documents speak for it; members of a class that meet in one block
are settled there: so a passage in a third of all documents doesn't gather in one place. What does
gather are different surroundings of one 20-byte string, in one task, 80 bytes each.

A row goes by its doc_id and, where a doc_id has several texts, the number of its text; documents are
earlier or later by doc_id alone.

Edge cases: a null text counts as empty; texts under 50 bytes lose nothing; texts of any length are
taken whole; rows that share a doc_id don't count as earlier than each other, and each is cut by the
documents before both; repeated rows are returned each; a null doc_id loses nothing and takes nothing
from others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, parallelism, small_batches, stage, utf8
from .sharding import numbered

LENGTH, Q = 50, 20
SIDE = LENGTH - Q  # bytes on either side of a sampled bucket
WIDTH = SIDE + LENGTH
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * _ODD)
_NONE = np.uint64(2**64 - 1)
#: Bytes that are hashed at once: the buckets of all lengths stay in a core's cache.
SLICE = 256 << 10
#: Bytes of text that are packed together, and class members that are refined together.
PACK, BLOCK = 8 << 20, 4096
#: Rows that are sent to every task rather than dealt.
SMALL = 100_000
_NAMES = np.uint64((1 << 32) - 1)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The bucket of two adjoining parts."""
    x = a * _ODD
    x ^= x >> np.uint64(29)
    x += b
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def hashed(buf: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n bytes from every position with so many to come."""
    have, k = {1: _BYTES[buf]}, 1
    while 2 * k <= n:
        h = have[k]
        have[2 * k] = _join(h[: max(0, len(h) - k)], h[k:])
        k *= 2
    part, at, out = n - k, k, have[k]
    while part:
        p = 1 << (part.bit_length() - 1)
        later = have[p][at:]
        out = _join(out[: len(later)], later)
        at, part = at + p, part - p
    return out


def _sliding(f: Callable, h: np.ndarray, w: int) -> np.ndarray:
    k = 1
    while 2 * k <= w:
        h = f(h[:-k], h[k:])
        k *= 2
    return f(h[: len(h) - (w - k)], h[w - k :]) if k < w else h


def _sampled(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = np.array([len(x) for x in parts], np.int64)
    buf = np.frombuffer(b"".join(parts), np.uint8)
    w = SIDE + 1
    if len(buf) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = hashed(buf, Q)
    end = np.cumsum(size)
    part = np.repeat(np.arange(len(parts)), size)
    left = end[part] - np.arange(len(buf))
    h[left[: len(h)] < Q] = _NONE
    least = _sliding(np.minimum, h, w)
    least[left[: len(least)] < LENGTH] = 0
    around = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    at = np.flatnonzero(_sliding(np.maximum, around, w)[: len(h)] == h)
    return part[at], at - (end - size)[part[at]], h[at]


def sampled(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """part, offset and 20-byte bucket of the positions that are least in some window of a part."""
    out, at, size = [], 0, 0
    for i, x in enumerate(parts):
        size += len(x)
        if size >= SLICE or i == len(parts) - 1:
            p, o, h = _sampled(parts[at : i + 1])
            out.append((p + at, o, h))
            at, size = i + 1, 0
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else _sampled([])


def slices(raw: bytes) -> Iterator[tuple[int, bytes]]:
    """Long texts in overlapping slices that hold every window once at least."""
    for s in range(0, max(1, len(raw) - LENGTH + 1), SLICE):
        yield s, raw[s : s + SLICE + LENGTH - 1]


def _blob(*columns: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(3).compress(b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def _unblob(data: bytes, n: int, kinds: tuple) -> list[np.ndarray]:
    """The columns; documents are written as differences."""
    raw, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    for kind, width in kinds:
        size = np.dtype(kind).itemsize * width * n
        a = np.frombuffer(raw[at : at + size], kind)
        out.append(a.reshape(n, width) if width > 1 else a)
        at += size
    out[0] = np.cumsum(out[0])
    return out


ROW = "slot long, kind int, n int, body binary"
_SCHEMA = [("slot", pa.int64()), ("kind", pa.int32()), ("n", pa.int32()), ("body", pa.binary())]


def _batches(rows: list[tuple], most: int = 64) -> Iterator[pa.RecordBatch]:
    for a in range(0, len(rows), most):
        some = rows[a : a + most]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in some], t) for i, (_, t) in enumerate(_SCHEMA)], [n for n, _ in _SCHEMA])


def _dealt(slot: np.ndarray, kind: int, doc: np.ndarray, columns: list[np.ndarray]) -> list[tuple]:
    """A packed row for each slot, in the order of the documents."""
    if not len(slot):
        return []
    order = np.lexsort((doc, slot))
    slot, doc = slot[order], doc[order]
    columns = [c[order] for c in columns]
    cut = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    return [(int(slot[a]), kind, int(b - a), _blob(np.diff(doc[a:b], prepend=0), *(c[a:b] for c in columns))) for a, b in zip(cut, np.append(cut[1:], len(slot)), strict=True)]


# a document is its doc_id and the number of its text
_FIRST = (("<i8", 1), ("<i8", 1), ("<u4", 1))  # document, name
_UNITS = (("<i8", 1), ("<i8", 1))
_TEXTS = (("<i8", 1), ("<i8", 1), ("<i8", 1))  # document, size of its text
_AROUND = (("<i8", 1), ("<i8", 1), ("<i8", 1), ("<u1", 1), ("<u1", 1), ("<u1", WIDTH))
_MASKS = (("<i8", 1), ("<i8", 1), ("<i8", 1), ("<u4", 1))  # document, offset, windows
_WINDOWS = np.arange(SIDE + 1)
KNOWN, NAMED, COPY, TEXT = 0, 1, 2, 3


def _chunk(doc: np.ndarray, alt: np.ndarray, chunks: int) -> np.ndarray:
    """The slot of a document."""
    return (mix64(doc.astype(np.int64).view(np.uint64) * _ODD + alt.astype(np.int64).view(np.uint64)) % np.uint64(chunks)).astype(np.int64)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Rows of sorted batches by slot, one slot at a time, a few rows at a time."""
    rows = (r for b in batches for at in range(0, b.num_rows, 16) for r in zip(*(b.column(i).slice(at, 16).to_pylist() for i in range(4)), strict=True))
    return itertools.groupby(rows, key=lambda r: r[0])


def _unique(*columns: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Rows sorted by the columns, without repeats, and whether each differs from the last in the first column."""
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(max(1, len(order)), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    columns = [c[new[: len(c)]] for c in columns]
    return columns, np.r_[True, columns[0][1:] != columns[0][:-1]][: len(columns[0])]


def _several(first: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Of rows sorted by bucket and doc_id: whether the bucket has two doc_ids."""
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, len(first)))
    return np.repeat(doc[start] != doc[start + size - 1], size)


def _sample_step(buckets: int, chunks: int, most: int = 600_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            (h, doc, alt), first = _unique(*(np.concatenate(c) for c in zip(*held, strict=True)))
            name = (h & _NAMES).astype("<u4")
            known = _several(first, doc)
            last = np.r_[first[1:], True][: len(first)]
            # of a bucket that is known to repeat its first and its last document tell the others
            tell = ~known | first | last
            rows = _dealt(_chunk(doc[known], alt[known], chunks), KNOWN, doc[known], [alt[known], name[known]])
            slot = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            return _batches(rows + _dealt(slot[tell], NAMED, doc[tell], [alt[tell], name[tell]]))

        for b in batches:
            parts, at = [], []
            for i, raw in enumerate(b.column(2).to_pylist()):
                if len(raw) >= LENGTH:
                    for _, x in slices(raw):
                        parts.append(x)
                        at.append(i)
            if parts:
                p, _, h = sampled(parts)
                own = np.array(at, np.int64)[p]
                held.append((h, *(b.column(i).to_numpy(zero_copy_only=False)[own] for i in (0, 1))))
                count += len(h)
            if count >= most:
                yield from flush()
                held, count = [], 0
        if count:
            yield from flush()

    return run


def _repeat_step(chunks: int):
    """Of each bucket with two doc_ids or more: its documents, dealt by chunk. Known ones pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, rows in _grouped(batches):
            got = []
            for _, kind, n, body in rows:
                if kind == KNOWN:
                    yield from _batches([(slot, NAMED, n, body)])
                else:
                    got.append(_unblob(body, n, _FIRST))
            if got:
                doc, alt, name = (np.concatenate(c) for c in zip(*got, strict=True))
                (name, doc, alt), first = _unique(name, doc, alt)
                many = _several(first, doc)
                yield from _batches(_dealt(_chunk(doc[many], alt[many], chunks), NAMED, doc[many], [alt[many], name[many]]))

    return run


def _packed(kind: int, chunks: int):
    """doc_id, number and text (or none) packed by the document's slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, list[bytes]]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            doc, alt = (np.concatenate([h[i] for h in held]).astype(np.int64) for i in (0, 1))
            slot = _chunk(doc, alt, chunks)
            if kind == COPY:
                return _batches(_dealt(slot, kind, doc, [alt]))
            texts = [t for h in held for t in h[2]]
            out = []
            for k in np.unique(slot):
                own = np.flatnonzero(slot == k)
                some = [texts[i] for i in own]
                out.append((int(k), kind, len(own), _blob(np.diff(doc[own], prepend=0), alt[own], np.array([len(t) for t in some], np.int64), np.frombuffer(b"".join(some), np.uint8))))
            return _batches(out, 16)

        for b in batches:
            bodies = b.column(2).to_pylist() if kind == TEXT else []
            held.append((b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False), bodies))
            size += sum(map(len, bodies)) + 16 * b.num_rows
            if size >= PACK:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return run


def _unpacked(n: int, body: bytes) -> Iterator[tuple[tuple[int, int], bytes]]:
    """((doc_id, number), text) of a packed row of texts."""
    raw = zstandard.ZstdDecompressor().decompress(body)
    doc, alt, size = (np.frombuffer(raw, "<i8", n, 8 * n * i) for i in range(3))
    at = 24 * n
    for d, a, length in zip(np.cumsum(doc).tolist(), alt.tolist(), size.tolist(), strict=True):
        yield (d, a), raw[at : at + length]
        at += length


def _valid(la: np.ndarray, ra: np.ndarray) -> np.ndarray:
    """Which of the 31 windows lie in the document; window t starts t bytes before the bucket."""
    return (_WINDOWS[None, :] <= la[:, None]) & (SIDE - _WINDOWS[None, :] <= ra[:, None])


def _bits(ok: np.ndarray) -> np.ndarray:
    return (ok.astype(np.uint32) << _WINDOWS.astype(np.uint32)).sum(axis=1, dtype=np.uint32)


def _settled(doc: np.ndarray, la: np.ndarray, ra: np.ndarray, ctx: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by class and then document; True at the first of each class; and whether a row is of a later
    document than its class's first. A hash puts equal surroundings together, and their bytes decide."""
    n = len(doc)
    whole = np.empty(n, np.uint64)
    for a in range(0, n, 2048):
        some = ctx[a : a + 2048]
        whole[a : a + 2048] = hashed(some.ravel(), WIDTH)[::WIDTH]
    order = np.lexsort((doc, whole))
    first = np.ones(n, bool)
    for a in range(1, n, 65536):
        x, y = order[a : a + 65536], order[a - 1 : a - 1 + len(order[a : a + 65536])]
        first[a : a + 65536] = (whole[x] != whole[y]) | (la[x] != la[y]) | (ra[x] != ra[y]) | (ctx[x] != ctx[y]).any(axis=1)
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    return order, first, doc[order] > doc[order][start]


def _around_step(buckets: int, chunks: int, most: int = 100_000):
    """Documents with their repeating buckets to the surroundings, dealt by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        count = 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, doc, alt, at, la, ra, ctx = (np.concatenate(c) for c in zip(*held, strict=True))
            order, _, later = _settled(doc, la, ra, ctx)
            gone, kept = order[later], order[~later]
            rows = _dealt((h[kept] % np.uint64(buckets)).astype(np.int64), NAMED, doc[kept], [alt[kept], at[kept], la[kept], ra[kept], ctx[kept]])
            rows += _dealt(_chunk(doc[gone], alt[gone], chunks), KNOWN, doc[gone], [alt[gone], at[gone], _bits(_valid(la[gone], ra[gone]))])
            return _batches(rows)

        for _, rows in _grouped(batches):
            named, done = [], set()
            docs_of: dict[tuple[int, int], int] | None = None
            for _, kind, n, body in rows:
                if kind == COPY:
                    doc, alt = _unblob(body, n, _UNITS)
                    done.update(zip(doc.tolist(), alt.tolist(), strict=True))
                elif kind == NAMED:
                    named.append(_unblob(body, n, _FIRST))
                elif named:
                    if docs_of is None:
                        doc, alt, name = (np.concatenate(c) for c in zip(*named, strict=True))
                        (doc, alt, name), _ = _unique(doc, alt, name)
                        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (alt[1:] != alt[:-1])])
                        docs_of = {k: i for i, k in enumerate(zip(doc[new].tolist(), alt[new].tolist(), strict=True))}
                        place = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(doc))))
                        ready = (place.astype(np.uint64) << np.uint64(32)) | name.astype(np.uint64)
                    for key, text in _unpacked(n, body):
                        k = docs_of.get(key)
                        if key in done or k is None:
                            continue
                        done.add(key)  # a repeated row has the same answer
                        raw = np.frombuffer(bytes(SIDE) + text + bytes(SIDE), np.uint8)
                        for s, x in slices(text):
                            _, at, h = sampled([x])
                            own = (np.uint64(k) << np.uint64(32)) | (h & _NAMES)
                            j = np.minimum(np.searchsorted(ready, own), len(ready) - 1)
                            ok = ready[j] == own
                            at, h = at[ok] + s, h[ok]
                            if len(at):
                                la = np.minimum(SIDE, at).astype(np.uint8)
                                ra = np.minimum(SIDE, len(text) - at - Q).astype(np.uint8)
                                held.append((h, np.full(len(at), key[0], np.int64), np.full(len(at), key[1], np.int64), at, la, ra, raw[at[:, None] + np.arange(WIDTH)]))
                                count += len(at)
                        if count >= most:
                            yield from flush()
                            held, count = [], 0
        if held:
            yield from flush()

    return run


def bucket_pointers(ctx: np.ndarray, depth: int = LENGTH, q: int = 8) -> np.ndarray:
    """(rows, width) bytes to (rows, width - depth + 1): a number for each position, equal where the next
    `depth` bytes are. Positions start in buckets of q bytes with the bucket's place in the sorted order
    for a pointer. The members of buckets that hold several are then sorted on the pointers of the
    positions that follow the bytes already equal, which gives new buckets and pointers."""
    rows, width = ctx.shape
    wide = width - q + 1
    words = np.zeros((rows, wide), np.uint64)
    for i in range(q):
        words = (words << np.uint64(8)) | ctx[:, i : i + wide]
    flat = words.ravel()
    order = np.argsort(flat)
    new = np.r_[True, flat[order][1:] != flat[order][:-1]]
    pointer = np.empty(rows * wide, np.int64)
    pointer[order] = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    size = q
    while size < depth:
        step = min(size, depth - size)  # the next depth is reached by buckets that overlap
        size += step
        inside = np.arange(width - size + 1)
        at = (np.arange(rows)[:, None] * wide + inside[None, :]).ravel()
        own = pointer[at]
        order = np.argsort(own)
        edge = np.r_[True, own[order][1:] != own[order][:-1], True]
        several = order[~(edge[:-1] & edge[1:])]
        at, own = at[several], own[several]  # in the order of their buckets
        later = pointer[at + step]
        order = np.argsort(own * len(pointer) + later)  # by bucket, then by pointer: both are below the number of positions
        at, own, later = at[order], own[order], later[order]
        start = np.r_[True, own[1:] != own[:-1]][: len(own)]
        new = start | np.r_[True, later[1:] != later[:-1]][: len(own)]
        place = np.arange(len(own))
        begin = np.maximum.accumulate(np.where(start, place, 0))
        pointer[at] = own + np.maximum.accumulate(np.where(new, place, 0)) - begin
    return pointer.reshape(rows, wide)[:, : width - depth + 1]


def _earlier(doc: np.ndarray, la: np.ndarray, ra: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """(rows, 31): which valid windows also stand around a row of an earlier document."""
    ok = _valid(la, ra)
    row, col = np.nonzero(ok)
    name = bucket_pointers(ctx)[row, SIDE - col]
    _, rank = np.unique(doc, return_inverse=True)
    order = np.argsort(name * len(doc) + rank[row])
    start = np.r_[True, name[order][1:] != name[order][:-1]]
    low = doc[row][order][np.maximum.accumulate(np.where(start, np.arange(len(order)), 0))]
    hit = np.zeros(ok.shape, bool)
    hit[row[order], col[order]] = doc[row][order] > low
    return hit


def _window_step(chunks: int):
    """Surroundings of each bucket to the windows that also start in an earlier document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for slot, rows in _grouped(batches):
            got = []
            for _, kind, n, body in rows:
                if kind == KNOWN:
                    yield from _batches([(slot, NAMED, n, body)])
                else:
                    got.append(_unblob(body, n, _AROUND))
            if not got:
                continue
            doc, alt, at, la, ra, ctx = (np.concatenate(c) for c in zip(*got, strict=True))
            del got
            order, first, later = _settled(doc, la, ra, ctx)
            # one member of each class speaks for it; rows that share its doc_id follow it
            of_class = np.cumsum(first) - 1
            heads = order[first]
            answer = np.zeros(len(heads), np.uint32)
            h = np.concatenate([hashed(ctx[heads[a : a + 8192], SIDE : SIDE + Q].ravel(), Q)[::Q] for a in range(0, len(heads), 8192)])
            by_bucket = np.argsort(h, kind="stable")
            edge = np.append(np.flatnonzero(np.r_[True, h[by_bucket][1:] != h[by_bucket][:-1]]), len(h))
            many = np.flatnonzero(np.diff(edge) > 1)  # buckets with several classes
            some: list[np.ndarray] = []
            for i, b in enumerate(many.tolist()):
                some.append(by_bucket[edge[b] : edge[b + 1]])
                if sum(map(len, some)) >= BLOCK or i == len(many) - 1:
                    own = np.concatenate(some)
                    x = heads[own]
                    answer[own] = _bits(_earlier(doc[x], la[x], ra[x], ctx[x]))
                    some = []
            mask = answer[of_class]
            mask[later] = _bits(_valid(la[order[later]], ra[order[later]]))
            rows_of = order[mask > 0]
            out = _dealt(_chunk(doc[rows_of], alt[rows_of], chunks), NAMED, doc[rows_of], [alt[rows_of], at[rows_of], mask[mask > 0]])
            yield from _batches(out)

    return run


def cut(raw: bytes, at: np.ndarray, mask: np.ndarray) -> tuple[int, int, str]:
    """Bytes removed, runs removed, digest of the rest."""
    begins = np.zeros(len(raw) + 1, bool)
    for t in range(SIDE + 1):
        begins[at[(mask >> np.uint32(t)) & np.uint32(1) == 1] - t] = True
    last = np.maximum.accumulate(np.where(begins, np.arange(len(begins)), -LENGTH))
    gone = (np.arange(len(begins)) - last < LENGTH)[:-1]
    runs = int(np.count_nonzero(gone[1:] & ~gone[:-1])) + int(len(gone) > 0 and gone[0])
    return int(gone.sum()), runs, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()


SHORTER = "_doc long, _alt long, n_removed long, n_spans long, kept_sha256 string"


def _cut_step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = [("_doc", pa.int64()), ("_alt", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(kinds)], [n for n, _ in kinds])

    for _, rows in _grouped(batches):
        got, done = [], set()
        edges: dict[tuple[int, int], tuple[int, int]] | None = None
        for _, kind, n, body in rows:
            if kind == COPY:
                doc, alt = _unblob(body, n, _UNITS)
                done.update(zip(doc.tolist(), alt.tolist(), strict=True))
            elif kind == NAMED:
                got.append(_unblob(body, n, _MASKS))
            elif got:
                if edges is None:
                    doc, alt, at, mask = (np.concatenate(c) for c in zip(*got, strict=True))
                    order = np.lexsort((alt, doc))
                    doc, alt, at, mask = (c[order] for c in (doc, alt, at, mask))
                    new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (alt[1:] != alt[:-1])])
                    edges = dict(zip(zip(doc[new].tolist(), alt[new].tolist(), strict=True), zip(new.tolist(), np.append(new, len(doc))[1:].tolist(), strict=True), strict=True))
                for key, text in _unpacked(n, body):
                    if key in edges and key not in done:
                        done.add(key)  # a repeated row has the same answer
                        a, b = edges[key]
                        out.append((*key, *cut(text, at[a:b], mask[a:b].astype(np.uint32))))
        if len(out) >= 200:
            yield batch()
            out = []
    if out:
        yield batch()


def _with_first(base: DataFrame) -> DataFrame:
    """base with _first, the least doc_id of each digest. Digests of very many rows are joined apart, so
    that they don't meet in one task."""
    groups = stage(base.filter("doc_id is not null").groupBy("sha").agg(F.min("doc_id").alias("_first"), F.count("*").alias("_n")).filter("_n > 1"), "groups")
    large = groups.filter("_n >= 1000").select("sha", F.col("_first").alias("_large"))
    if large.limit(SMALL + 1).count() > SMALL:
        return base.join(groups.select("sha", "_first"), "sha", "left")
    rows = base.join(F.broadcast(large), "sha", "left")  # at most SMALL digests
    rest = rows.filter("_large is null").drop("_large").join(groups.filter("_n < 1000").select("sha", "_first"), "sha", "left")
    return rest.unionByName(rows.filter("_large is not null").withColumnRenamed("_large", "_first"))


def _with_number(rows: DataFrame, base: DataFrame) -> DataFrame:
    """rows (doc_id, sha) with alt: 0, or the number of the text where a doc_id has several."""
    own = base.filter(f"doc_id is not null and n_bytes >= {LENGTH}").select("doc_id", "sha")
    several = own.groupBy("doc_id").agg(F.min("sha").alias("_lo"), F.max("sha").alias("_hi")).filter("_lo <> _hi").select("doc_id")
    texts = stage(own.join(several, "doc_id", "left_semi").distinct(), "texts")
    n = texts.limit(SMALL + 1).count()
    if not n:
        return rows.withColumn("alt", F.lit(0).cast("long"))
    named, _ = numbered(texts, ["doc_id", "sha"])
    named = named.select("doc_id", "sha", (F.col("row_no") + 1).alias("alt"))
    joined = rows.join(F.broadcast(named) if n <= SMALL else named, ["doc_id", "sha"], "left")
    return joined.withColumn("alt", F.coalesce("alt", F.lit(0)).cast("long"))


def remove_repeats(docs: DataFrame, chunk_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of docs."""
    spark = docs.sparkSession
    small_batches(spark)
    parts = parallelism(spark)
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.col("text").cast("string")).alias("body"))
    base = stage(raw.select("doc_id", F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("sha")), "base")
    total = base.agg(F.sum("n_bytes")).first()[0] or 0
    chunks = buckets = max(1, -(-int(total) // chunk_bytes))
    copy = F.coalesce((F.col("_first") < F.col("doc_id")) & (F.col("n_bytes") >= LENGTH), F.lit(False))
    base = stage(_with_number(_with_first(base).withColumn("_copy", copy).drop("_first"), base), "copies")

    long = raw.filter("doc_id is not null").filter(F.octet_length("body") >= LENGTH).withColumn("sha", F.sha2("body", 256))
    rows = _with_number(long, base).select("doc_id", "alt", "body")
    texts = rows.mapInArrow(_packed(TEXT, chunks), ROW)
    copies = base.filter("_copy").select("doc_id", "alt").mapInArrow(_packed(COPY, chunks), ROW)

    def by_slot(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "slot").sortWithinPartitions("slot", "kind")

    names = rows.mapInArrow(_sample_step(buckets, chunks), ROW)
    repeats = by_slot(names).mapInArrow(_repeat_step(chunks), ROW)
    around = by_slot(repeats.unionByName(copies).unionByName(texts)).mapInArrow(_around_step(-(-buckets // 4), chunks), ROW)  # fewer and larger blocks pack better
    masks = stage(by_slot(around).mapInArrow(_window_step(chunks), ROW), "masks")
    shorter = by_slot(masks.unionByName(copies).unionByName(texts)).mapInArrow(_cut_step, SHORTER)
    out = base.join(shorter, (base["doc_id"] == shorter["_doc"]) & (base["alt"] == shorter["_alt"]) & (base["n_bytes"] >= LENGTH), "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(F.col("_copy"), F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("_copy"), F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(F.col("_copy"), F.lit(empty)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
