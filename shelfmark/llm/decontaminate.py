"""Benchmark passages in documents, by CGK embedding, bit-sampling LSH and exact edit distance.

Texts become word sequences. An item of m words may differ by m // 4 word edits (none under 8 words,
one at 8). From every word of a document, and of an item, a CGK random walk sets out: at each step the
word at the pointer is put out, and a random bit of (step, word) tells whether the pointer moves on.
So edit distance becomes Hamming distance of the embeddings: after an edit two walks fall into step
again. SAMPLES bit samples of TAKEN steps from each of WALKS walks are the LSH keys; a key of a
document that is also one of an item, from its i-th word, proposes the item-sized window that starts i
words before. As walks set out from all words of the item, a run of three or four words that stays
whole, or nearly, is enough for some of the keys to meet, wherever the edits are: recall at the largest
distance is measured in the tests, for lengths from 8 to 300 words. Samples that see fewer than TAKEN
different places say too little and make no key. Items under 8 words, which allow no edit, are found by
their first three words.

A proposed window is verified by exact edit distance with free ends; before, it is dropped if the
item's words (counted) that are absent from the text around it outnumber the edits, which no match can
have. The benchmark's words are counted first; a block of at most MOST_WORDS of them is sent to the
tasks, and a larger benchmark is searched in several blocks, each against all documents.

Edge cases: a null or empty text or item matches nothing; a repeated item_id is searched as one item
for each distinct text; a document is reported once for each item, with the distance at the window that
most keys propose; null doc_ids are reported as null; repeated rows and rows that share a doc_id are
searched each; a text of any length is searched whole; empty tables give an empty result; other columns
are ignored by contaminated, and returned by decontaminated whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, mix64, small_batches

WALKS, STEPS, SAMPLES, TAKEN = 3, 8, 8, 3
MOST_WORDS = 200_000
#: Words of documents that are embedded at once: the walks stay in a core's cache.
SLICE = 1 << 15
#: ASCII other than letters and digits parts words; all else belongs to them.
_PARTS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_PARTS).split()


def allowed(m: int) -> int:
    return m // 4 if m > 8 else int(m == 8)


def embed(w: np.ndarray, walk: int) -> np.ndarray:
    """CGK from every word at once: (STEPS, words), the places whose words are put out. w: word numbers,
    -1 for words that no item has; the last STEPS are padding."""
    noise = mix64((w + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(walk * 0x632BE5AB + 1))
    at = np.empty((STEPS, len(w) - STEPS), np.int64)
    at[0] = np.arange(at.shape[1])
    for j in range(1, STEPS):
        moves = ((noise >> np.uint64(j)) & np.uint64(1)).astype(np.int8)
        np.add(at[j - 1], moves[at[j - 1]], out=at[j])
    return at


def samples() -> list[list[tuple[int, ...]]]:
    """The steps that each walk's samples take."""
    rng = np.random.default_rng(5)
    every = list(combinations(range(STEPS), TAKEN))
    return [[every[i] for i in rng.choice(len(every), SAMPLES, replace=False)] for _ in range(WALKS)]


TAKES = samples()


def keys(w: np.ndarray, shift: int | None = None, seen: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """place, key of every sample from every word of w (padded as for embed). seen: which keys' top
    bits to look out for, with their shift; others are left out."""
    places, out = [], []
    for walk, takes in enumerate(TAKES):
        at = embed(w, walk)
        start = np.flatnonzero(w[: at.shape[1]] >= 0)
        at = at[:, start]
        words = w[at]
        for k, take in enumerate(takes):
            ok = words[take[0]] >= 0
            code = words[take[0]]
            for i, j in zip(take, take[1:], strict=False):
                ok = ok & (at[j] > at[i]) & (words[j] >= 0)
                code = (code << 21) | words[j]
            code = (code.view(np.uint64) ^ np.uint64((walk * SAMPLES + k + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
            code ^= code >> np.uint64(29)
            code *= np.uint64(0x94D049BB133111EB)
            if seen is not None:
                ok &= seen[code >> np.uint64(shift)]
            places.append(start[ok])
            out.append(code[ok])
    return np.concatenate(places), np.concatenate(out)


def infix_distance(item: np.ndarray, text: np.ndarray) -> tuple[int, int]:
    """The least edits between item and any part of text, and where that part ends."""
    n = len(text)
    ramp = np.arange(n + 1)
    row = np.zeros(n + 1, np.int64)
    for i, w in enumerate(item, 1):
        new = np.empty(n + 1, np.int64)
        new[0] = i
        new[1:] = np.minimum(row[:-1] + (text != w), row[1:] + 1)
        row = np.minimum.accumulate(new - ramp) + ramp
    end = int(np.argmin(row))
    return int(row[end]), end


class Index:
    """The items of one block."""

    def __init__(self, items: list[tuple[int, str]]):
        self.vocab: dict[bytes, int] = {}
        self.items: list[tuple[int, np.ndarray]] = []
        for key, text in items:
            own = words(text)
            if own:
                self.items.append((key, np.array([self.vocab.setdefault(w, len(self.vocab)) for w in own], np.int64)))
        self.counted = [np.unique(w, return_counts=True) for _, w in self.items]
        # items that allow edits, one after another
        loose = [k for k, (_, w) in enumerate(self.items) if allowed(len(w))]
        parts, item, anchor = [], [], []
        for k in loose:
            w = self.items[k][1]
            parts += [w, np.full(STEPS, -1)]
            item.append(np.full(len(w) + STEPS, k))
            anchor.append(np.arange(len(w) + STEPS))
        self.bits = 12
        self.code = np.zeros(0, np.uint64)
        if loose:
            place, code = keys(np.concatenate(parts))
            order = np.argsort(code, kind="stable")
            self.code, self.first = np.unique(code[order], return_index=True)
            self.first = np.append(self.first, len(code))
            self.item, self.anchor = np.concatenate(item)[place[order]].astype(np.int32), np.concatenate(anchor)[place[order]].astype(np.int32)
            self.bits = max(12, int(16 * len(self.code)).bit_length())
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.code >> np.uint64(64 - self.bits)] = True
        # short items by their first words
        self.short: dict[int, dict[tuple[int, ...], list[int]]] = {}
        for k, (_, w) in enumerate(self.items):
            if not allowed(len(w)):
                r = min(3, len(w))
                self.short.setdefault(r, {}).setdefault(tuple(w[:r].tolist()), []).append(k)

    def proposed(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """item, window start and place of every key that the (padded) text shares with an item."""
        found = []
        if len(self.code):
            place, code = keys(text, 64 - self.bits, self.seen)
            k = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
            ok = self.code[k] == code
            place, k = place[ok], k[ok]
            size = self.first[k + 1] - self.first[k]
            row = np.repeat(self.first[k] - np.cumsum(size) + size, size) + np.arange(size.sum())
            place = np.repeat(place, size)
            found.append((self.item[row], place - self.anchor[row], place))
        for r, runs in self.short.items():
            heads = np.isin(text, [run[0] for run in runs])
            for p in np.flatnonzero(heads).tolist():
                for k in runs.get(tuple(text[p : p + r].tolist()), ()):
                    found.append((np.array([k]), np.array([p]), np.array([p])))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(c).astype(np.int64) for c in zip(*found, strict=True))

    def absent(self, k: int, text: np.ndarray) -> int:
        """How many words of item k text lacks, counted with repeats: no part of text is fewer edits away."""
        kinds, counts = self.counted[k]
        own = np.sort(text)
        held = np.searchsorted(own, kinds, "right") - np.searchsorted(own, kinds, "left")
        return int(np.maximum(counts - held, 0).sum())

    def verified(self, k: int, text: np.ndarray, hits: np.ndarray) -> tuple[int, int, int, int] | None:
        """(item_id, words of the item, distance, start) of item k in text near one of the proposed starts."""
        key, w = self.items[k]
        m, most = len(w), allowed(len(w))
        start, near = np.unique(hits, return_counts=True)
        near = np.cumsum(near)
        near = near[np.searchsorted(start, start + most, "right") - 1] - np.append(0, near)[np.searchsorted(start, start - most)]
        while len(start):  # the window with the most support, and those that overlap it, first
            s = int(start[np.argmax(near)])
            far = np.abs(start - s) > most
            start, near = start[far], near[far]
            lo = max(0, s - 2 * most)
            around = text[lo : max(0, s + m + 2 * most)]
            if self.absent(k, around) <= most:
                d, end = infix_distance(w, around)
                if d <= most:
                    return key, m, d, max(0, lo + end - m)
        return None

    def search(self, texts: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """What each text holds; texts are embedded together, about SLICE words at once."""
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in texts]
        pad, done = np.full(STEPS, -1, np.int64), 0
        while done < len(texts):
            first, size = done, 0
            while done < len(texts) and (done == first or size + len(texts[done]) <= SLICE):
                size += len(texts[done]) + STEPS
                done += 1
            some = texts[first:done]
            begin = np.cumsum([0] + [len(t) + STEPS for t in some])
            whole = np.concatenate([x for t in some for x in (t, pad)])
            item, start, place = [], [], []
            for a in range(0, max(1, len(whole) - STEPS), SLICE):  # a longer text's slices overlap by the steps
                k, s, p = self.proposed(whole[a : a + SLICE + STEPS])
                item.append(k)
                start.append(s + a)
                place.append(p + a)
            item, start, place = map(np.concatenate, (item, start, place))
            text = np.searchsorted(begin, place, "right") - 1
            order = np.lexsort((start, item, text))
            item, start, text = item[order], start[order], text[order]
            edge = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (text[1:] != text[:-1])]) if len(item) else np.zeros(0, int)
            for a, b in zip(edge.tolist(), np.append(edge, len(item))[1:].tolist(), strict=True):
                t = int(text[a])
                if got := self.verified(int(item[a]), some[t], start[a:b] - begin[t]):
                    out[first + t].append(got)
        return out

    def matches(self, text: np.ndarray) -> list[tuple[int, int, int, int]]:
        return self.search([text])[0]


_KEPT: dict[str, Index] = {}


def _index(name: str, items: list[tuple[int, str]]) -> Index:
    """The last block's index, kept by a worker process for its next tasks."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = Index(items)
    return _KEPT[name]


OUT = "doc_id long, item_id long, item_words int, edits int, start_word int"


def contaminated(docs: DataFrame, benchmark: DataFrame, most_words: int = MOST_WORDS) -> DataFrame:
    """A row for each document and benchmark item it holds; other documents have none."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).filter("text is not null").distinct()
    size = items.agg(F.sum(F.regexp_count("text", F.lit(r"[^\s]+"))), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-int(size[0] or 0) // most_words), -(-int(size[1] or 0) // (16 * most_words)))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for block in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text").collect()  # at most about most_words words
        sent = spark.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])

        def search(batches: Iterator[pa.RecordBatch], sent=sent, name=uuid.uuid4().hex) -> Iterator[pa.RecordBatch]:
            index = _index(name, sent.value)
            for b in batches:
                texts = []
                for text in b.column(1).to_pylist():
                    own = words(text)
                    texts.append(np.fromiter(map(index.vocab.get, own, repeat(-1)), np.int64, len(own)))
                got = [(doc, *m) for doc, found in zip(b.column(0).to_pylist(), index.search(texts), strict=True) for m in found]
                if got:
                    cols = zip(*got, strict=True)
                    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "item_words", "edits", "start_word"])

        found = slim.mapInArrow(search, OUT)
        out = found if out is None else out.unionByName(found)
    return out


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark item, with their own columns."""
    name = free_name(docs, "_held")
    held = contaminated(docs, benchmark).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(held, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_anti")
