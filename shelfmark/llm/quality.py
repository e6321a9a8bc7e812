"""Quality rules: statistics of whole texts and a learned decision list over them.

The list is learned by sequential covering. Each rule is a conjunction of thresholds, grown by FOIL
gain on two thirds of the labelled rows that are left and pruned on the rest; rules are kept while
they are precise enough on all rows that are left, and the rows they cover are taken away before the
next. The list becomes one ordered conditional expression that Spark evaluates on every row. The
list doesn't depend on the layout of the files.

Only the fit uses a bounded sample: at most SAMPLE labelled documents, those with the least hash of
their id. Everything else covers every document.

Edge cases: a null or empty text has no words and fails the base; labels that are null are ignored
and of repeated labels the worst counts; with no labels of both kinds the list is empty and the base
alone decides; texts of any length are judged whole; repeated rows are judged each; an empty table
gives an empty result; quality_report ignores other columns, quality_filter returns them as they are,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_rows, small_batches

SAMPLE = 20_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "punct_share", "distinct_share", "word_punct_share", "n_words_f"]
_SYMBOLS = [ord(c) for c in "#*$%&|<>"]
_BLANKS = [32, 9, 10, 11, 12, 13]
#: Blanks to a space, ASCII punctuation to a stop, all else to a letter.
_KINDS = bytes(32 if c in _BLANKS else 97 if c >= 128 or chr(c).isalnum() else 46 for c in range(256))
_PUNCT = [c for c in range(33, 127) if not chr(c).isalnum()]


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """The counts of the base and the shares that rules may test."""
    raw = (text or "").encode()
    each = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = raw.split()
    n = len(words)
    chars = int(each.sum() - each[128:192].sum() - each[_BLANKS].sum())
    symbols = int(each[_SYMBOLS].sum())
    dup, seen = 0, set()
    lines = raw.split(b"\n")
    if len(lines) > 1:
        for line in lines:
            if line in seen:
                dup += 1
            elif line.strip(b" \t\n\x0b\x0c\r"):
                seen.add(line)
    repeat, distinct = 0, n
    if n:
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
        distinct = len(np.unique(h))
        if n > 3 and distinct < n:
            w = (h[:-2] * np.uint64(0x9E3779B97F4A7C15) + h[1:-1]) * np.uint64(0xC2B2AE3D27D4EB4F) + h[2:]
            order = np.argsort(w, kind="stable")
            same = w[order[1:]] == w[order[:-1]]
            if same.any():
                twice = np.zeros(len(w), bool)
                twice[order[1:][same]] = True
                twice[order[:-1][same]] = True
                cover = np.zeros(n, bool)
                cover[:-2] |= twice
                cover[1:-1] |= twice
                cover[2:] |= twice
                repeat = int(cover.sum())
    d, c = max(n, 1), max(chars, 1)
    kinds = raw.translate(_KINDS)
    ends = (kinds.count(b". ") + kinds.endswith(b".")) / d
    upper, digit, punct = (int(each[s].sum()) for s in (slice(65, 91), slice(48, 58), _PUNCT))
    return [n, chars, symbols, dup, repeat], [chars / d, symbols / d, dup / max(1, len(lines)), repeat / d, upper / c, digit / c, punct / c, distinct / d, ends, float(n)]


STRUCT = "struct<" + ", ".join([f"{c}:bigint" for c in COUNTS] + [f"{c}:double" for c in SHARES]) + ">"
_ARROW = pa.struct([(c, pa.int64()) for c in COUNTS] + [(c, pa.float64()) for c in SHARES])


def measured(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """docs with a struct of each row's statistics."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [statistics(t) for t in b.column(at).to_pylist()]
            counts, shares = (np.array([g[i] for g in got]).reshape(len(got), -1) for i in (0, 1))
            cols = [pa.array(counts[:, i].astype(np.int64)) for i in range(len(COUNTS))] + [pa.array(shares[:, i].astype(float)) for i in range(len(SHARES))] if got else [pa.array([], f.type) for f in _ARROW]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.StructArray.from_arrays(cols, fields=list(_ARROW))], [*b.schema.names, name])

    return map_rows(docs, run, T.StructType([*docs.schema, *T.StructType.fromDDL(f"{name} {STRUCT}")]))


@dataclass(frozen=True)
class Rule:
    """Reject where every (feature, above, threshold) holds."""

    terms: tuple[tuple[str, bool, float], ...]

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, t in self.terms:
            out &= x[name] > t if above else x[name] <= t
        return out

    def column(self, of: Column) -> Column:
        out = F.lit(True)
        for name, above, t in self.terms:
            out = out & (of[name] > t if above else of[name] <= t)
        return out


def _gain(p0: int, n0: int, p: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(p > 0, p * (np.log2(np.maximum(p, 1e-9) / np.maximum(p + n, 1e-9)) - np.log2(p0 / (p0 + n0))), -1.0)


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, most: int) -> list[tuple[str, bool, float]]:
    here = np.ones(len(bad), bool)
    terms: list[tuple[str, bool, float]] = []
    while len(terms) < most and (n0 := int((here & ~bad).sum())):
        p0, best = int((here & bad).sum()), (1e-6, None)
        for name, v in x.items():
            order = np.argsort(v[here], kind="stable")
            s, good = v[here][order], np.cumsum(bad[here][order])
            cut = np.flatnonzero(s[1:] > s[:-1])
            if not len(cut):
                continue
            p, total = good[cut], cut + 1
            for above, pp, nn in ((False, p, total - p), (True, p0 - p, n0 - total + p)):
                g = _gain(p0, n0, pp, nn)
                k = int(np.argmax(g))
                if g[k] > best[0]:
                    best = (g[k], (name, above, float((s[cut[k]] + s[cut[k] + 1]) / 2)))
        if best[1] is None:
            break
        terms.append(best[1])
        name, above, t = best[1]
        here &= x[name] > t if above else x[name] <= t
    return terms


def learn(x: dict[str, np.ndarray], bad: np.ndarray, seed: int = 7, most_rules: int = 24, most_terms: int = 4, precision: float = 0.9, least: int = 5) -> list[Rule]:
    """Sequential covering of the bad rows. precision: of a rule on all rows that are left, smoothed."""
    rng = np.random.default_rng(seed)
    left, rules = np.ones(len(bad), bool), []
    while len(rules) < most_rules and (left & bad).sum() >= least and (left & ~bad).any():
        rows = rng.permutation(np.flatnonzero(left))
        cut = len(rows) * 2 // 3
        grow, prune = rows[:cut], rows[cut:]
        if not bad[grow].any() or bad[grow].all():
            break
        terms = _grow({k: v[grow] for k, v in x.items()}, bad[grow], most_terms)
        if not terms:
            break
        held = {k: v[prune] for k, v in x.items()}

        def worth(ts: list[tuple[str, bool, float]], held=held, prune=prune) -> float:
            c = Rule(tuple(ts)).holds(held)
            p, n = int((c & bad[prune]).sum()), int((c & ~bad[prune]).sum())
            return (p - n) / (p + n + 1)

        terms = max((terms[: i + 1] for i in reversed(range(len(terms)))), key=worth)
        rule = Rule(tuple(terms))
        c = rule.holds({k: v[rows] for k, v in x.items()})
        p, n = int((c & bad[rows]).sum()), int((c & ~bad[rows]).sum())
        if p < least or (p + 1) / (p + n + 2) < precision:
            break
        rules.append(rule)
        gone = rows[c]
        left[gone] = False
    return rules


def verdict(rules: list[Rule], of: Column) -> Column:
    """The list as one ordered conditional: true keeps."""
    out = None
    for r in rules:
        out = F.when(r.column(of), F.lit(False)) if out is None else out.when(r.column(of), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[Rule]:
    """Rules from at most `sample` labelled documents of docs."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("_good")).dropna().groupBy("doc_id").agg(F.min("_good").alias("_good"))
    own = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # one row an id, so at most `sample` rows; of several documents with one id the least is taken
    one = measured(named.join(F.broadcast(own), "doc_id"), "_q").groupBy("doc_id").agg(F.min(F.struct("_good", *[F.col("_q")[c].alias(c) for c in SHARES])).alias("_m"))
    rows = one.select("doc_id", "_m.*").toPandas()
    if not len(rows):
        return []
    rows = rows.sort_values("doc_id")  # the layout of the files doesn't matter to the rules
    bad = (rows["_good"] == 0).to_numpy()
    return learn({c: rows[c].to_numpy(float) for c in SHARES}, bad) if bad.any() and not bad.all() else []


def base_failed(q: Column) -> Column:
    return (q["n_words"] < 50) | (100 * q["n_repeat_words"] > 50 * q["n_words"])


def quality_report(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the counts, base_failed and kept for each row of docs."""
    small_batches(docs.sparkSession)
    rules = fit(docs, labels, sample)
    q = F.col("_q")
    rows = measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), "_q")
    return rows.select("doc_id", *[q[c].alias(c) for c in COUNTS], base_failed(q).alias("base_failed"), (~base_failed(q) & verdict(rules, q)).alias("kept"))


def quality_filter(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    small_batches(docs.sparkSession)
    rules = fit(docs, labels, sample)
    name = free_name(docs, "_q")
    q = F.col(name)
    return measured(docs, name).filter(~base_failed(q) & verdict(rules, q)).drop(name)
