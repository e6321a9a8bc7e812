"""Secrets in texts: fixed patterns, and more spans by grammar inference.

The values that the fixed patterns find are labelled credentials. Of each kind a bounded number makes
a prefix tree whose states count how often a value goes on with each character or ends there. States
whose counts don't differ by more than chance allows (Hoeffding's bound, on the ends, on each
character, and on all that follows) are merged, from the root outwards, and what is left is a
probabilistic automaton of that kind's format: a fixed beginning stays a chain of states, random
characters become a loop. Runs of credential characters with a digit that no fixed span touches are
the candidates; a bounded number of these makes the automaton of the background, from which those are
taken, over some rounds, that a format explains better. Every candidate of every document is then
scored by all automata. One is a secret if a format makes it likelier than the background does by
MARGIN, and about as likely a character as that format's own credentials that weren't used to infer
it. The background is no less likely than random characters of the alphabets that a value uses, so a
run of digits is no credential because its first digit is new.

Edge cases: a null or empty text has no spans; a text of any length is searched whole, in time that
grows with its length; a null doc_id is kept; repeated rows and rows that share a doc_id are searched
each; spans of different kinds may overlap, of those of one kind none do; with fewer than LEAST
labelled credentials of a kind no format is inferred for it, and without any format nothing is added;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stage

BASE = ["assign", "access", "hex"]
#: What candidates add.
INFERRED = "inferred"
KINDS = [*BASE, INFERRED]

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: A whole run of 12 or more credential characters, and its padding; no mail address, no link.
_RUN = re.compile(r"(?<![A-Za-z0-9+/_.@-])(?!//)[A-Za-z0-9+/_.-]{12,}+={0,2}(?!@)")
_DIGIT = re.compile(r"[0-9]")

#: The most labelled credentials of a kind, and the most background candidates, that a grammar is inferred from.
FIT, BACKGROUND = 3000, 3000
#: Fewer labelled credentials of a kind infer no format.
LEAST = 20
#: How much likelier a format must make a candidate than the background does, in nats.
MARGIN = 2.0
#: The share of a format's own held-out credentials that may score below its limit, and how far below
#: these a candidate may be, in nats a character: it may be shorter, or end where none did.
BELOW, SLACK = 0.02, 0.25
#: The confidence of the test of two states, and what a character that a state never saw may weigh.
ALPHA, UNSEEN = 0.05, 1e-4
_END = ""


def fixed_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential) of the fixed patterns, by start and then kind as listed."""
    out = [(m.start(), m.end(), "assign", m[1]) for m in _ASSIGN.finditer(text) if len(m[1]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access", m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex", m[0]) for m in _HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


def candidates(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of the runs with a digit that touch no fixed span; full stops around a run
    aren't part of it. Both lists are in order, so each is walked once."""
    out, at = [], 0
    ends, last = [], 0
    for _, e, _, _ in taken:
        last = max(last, e)
        ends.append(last)
    if not _DIGIT.search(text):
        return out
    for m in _RUN.finditer(text):
        value = m[0].strip(".")
        if len(value) < 12 or not _DIGIT.search(value):
            continue
        start = m.start() + len(m[0]) - len(m[0].lstrip("."))
        end = start + len(value)
        while at < len(taken) and ends[at] <= start:
            at += 1
        if at == len(taken) or taken[at][0] >= end:
            out.append((start, end, value))
    return out


@dataclass(frozen=True)
class Automaton:
    """steps[state][character] is the next state and the log-likelihood; ends[state] that of ending."""

    steps: tuple[dict[str, tuple[int, float]], ...]
    ends: tuple[float, ...]

    def score(self, value: str) -> float:
        """The log-likelihood of the whole value; a character that a state never saw is dear and stays there."""
        state, total, unseen = 0, 0.0, math.log(UNSEEN)
        for c in value:
            hop = self.steps[state].get(c)
            if hop is None:
                total += unseen
            else:
                state, cost = hop
                total += cost
        return total + self.ends[state]


class _Tree:
    """A prefix tree of counts whose states can be merged."""

    def __init__(self, values: Iterable[str]):
        self.next: list[dict[str, int]] = [{}]
        self.passed: list[dict[str, int]] = [{}]
        self.total, self.end = [0], [0]
        for v in values:
            s = 0
            for c in v:
                self.total[s] += 1
                self.passed[s][c] = self.passed[s].get(c, 0) + 1
                if c not in self.next[s]:
                    self.next[s][c] = self._new()
                s = self.next[s][c]
            self.total[s] += 1
            self.end[s] += 1

    def _new(self) -> int:
        self.next.append({})
        self.passed.append({})
        self.total.append(0)
        self.end.append(0)
        return len(self.next) - 1

    def alike(self, a: int, b: int, alpha: float) -> bool:
        """Whether chance may explain how the counts of two states differ, and of all that follows b."""
        waiting = [(a, b)]
        width = math.sqrt(0.5 * math.log(2 / alpha))
        while waiting:
            p, q = waiting.pop()
            m, n = self.total[p], self.total[q]
            if not m or not n:
                continue
            most = width * (1 / math.sqrt(m) + 1 / math.sqrt(n))
            if abs(self.end[p] / m - self.end[q] / n) > most:
                return False
            if most < 1:
                for c in self.passed[p].keys() | self.passed[q].keys():
                    if abs(self.passed[p].get(c, 0) / m - self.passed[q].get(c, 0) / n) > most:
                        return False
            waiting += [(self.next[p][c], t) for c, t in self.next[q].items() if c in self.next[p]]
        return True

    def fold(self, a: int, b: int) -> None:
        """Add the tree below b to a."""
        waiting = [(a, b)]
        while waiting:
            p, q = waiting.pop()
            self.total[p] += self.total[q]
            self.end[p] += self.end[q]
            for c, n in self.passed[q].items():
                self.passed[p][c] = self.passed[p].get(c, 0) + n
            for c, t in self.next[q].items():
                if c in self.next[p]:
                    waiting.append((self.next[p][c], t))
                else:
                    self.next[p][c] = t


def infer(values: list[str], alpha: float = ALPHA) -> Automaton:
    """The automaton that is left when alike states of the values' prefix tree are merged. The order of
    the values doesn't matter."""
    tree = _Tree(sorted(values))
    red, blue = [0], sorted((c, 0) for c in tree.next[0])
    while blue:
        # the state that most values reach is settled first
        blue.sort(key=lambda e: (-tree.total[tree.next[e[1]][e[0]]], e[1], e[0]))
        c, source = blue.pop(0)
        state = tree.next[source][c]
        same = next((r for r in red if tree.alike(r, state, alpha)), None)
        if same is None:
            red.append(state)
        else:
            tree.next[source][c] = same
            tree.fold(same, state)
        kept = set(red)
        blue = [(d, r) for r in red for d, t in tree.next[r].items() if t not in kept]
    number = {s: i for i, s in enumerate(red)}
    steps, ends = [], []
    for s in red:
        n = tree.total[s]
        steps.append({c: (number[t], math.log(tree.passed[s][c] / n)) for c, t in sorted(tree.next[s].items())})
        ends.append(math.log(tree.end[s] / n) if tree.end[s] else math.log(UNSEEN))
    return Automaton(tuple(steps), tuple(ends))


#: Alphabets and their sizes; a value is drawn from those that it uses.
_ALPHABETS = [(re.compile("[0-9]"), 10), (re.compile("[a-z]"), 26), (re.compile("[A-Z]"), 26), (re.compile("[^A-Za-z0-9]"), 6)]


def _random(value: str) -> float:
    """The log-likelihood of random characters of the alphabets that value uses."""
    return -len(value) * math.log(sum(n for p, n in _ALPHABETS if p.search(value)) or 1)


@dataclass(frozen=True)
class Grammar:
    """The formats by kind, each with the least log-likelihood a character, and the background."""

    formats: tuple[tuple[str, Automaton, float], ...]
    background: Automaton | None

    def best(self, value: str) -> tuple[str, float] | None:
        """The kind whose format explains value, and by how much better than the background does."""
        found = [(score, k) for k, a, low in self.formats if (score := a.score(value)) >= low * len(value)]
        if not found:
            return None
        score, kind = max(found)
        plain = _random(value)
        if self.background:
            plain = max(plain, self.background.score(value))
        return (kind, score - plain) if score - plain >= MARGIN else None


def grammar(labelled: dict[str, list[str]], unlabelled: list[str], rounds: int = 3) -> Grammar:
    """The formats of the labelled values by kind, and the background that the unlabelled ones are."""
    formats = []
    for kind in BASE:
        values = sorted(labelled.get(kind, []))
        if len(values) < LEAST:
            continue
        # every fifth is held out to set the format's limit
        own, out = [v for i, v in enumerate(values) if i % 5], values[::5]
        a = infer(own)
        formats.append((kind, a, float(np.quantile([a.score(v) / len(v) for v in out], BELOW, method="lower")) - SLACK))
    rest, plain = sorted(unlabelled), None
    for _ in range(rounds):
        if len(rest) < LEAST:
            plain = None
            break
        plain = infer(rest)
        g = Grammar(tuple(formats), plain)
        kept = [v for v in rest if g.best(v) is None]
        if len(kept) == len(rest):
            break
        rest = kept
    return Grammar(tuple(formats), plain)


_SPAN = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("value", pa.string())])
FOUND = "array<struct<start:int, stop:int, kind:string, value:string>>"


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, fixed and proposed spans of each row's whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, new = [], []
            for t in b.column(1).to_pylist():
                spans = fixed_spans(t or "")
                own.append([{"start": s, "stop": e, "kind": k, "value": v} for s, e, k, v in spans])
                new.append([{"start": s, "stop": e, "kind": INFERRED, "value": v} for s, e, v in candidates(t or "", spans)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(_SPAN)), pa.array(new, pa.list_(_SPAN))], ["doc_id", "fixed", "proposed"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id long, fixed {FOUND}, proposed {FOUND}")


def _drawn(values: DataFrame, most: int) -> list[str]:
    """Different values, those with the least hash, so that neither copies nor layout matter."""
    return [r["value"] for r in values.select("value").distinct().orderBy(F.xxhash64("value"), "value").limit(most).collect()]


def fit(found: DataFrame, most: int = FIT, background: int = BACKGROUND) -> Grammar:
    """The grammar of the labelled credentials of found, of at most `most` a kind."""
    fixed = found.select(F.explode("fixed").alias("s")).select("s.*")
    labelled = {k: _drawn(fixed.filter(F.col("kind") == k), most) for k in BASE}
    return grammar(labelled, _drawn(found.select(F.explode("proposed").alias("s")).select("s.value"), background))


def inferred(found: DataFrame, g: Grammar) -> DataFrame:
    """found with more: its proposed spans that the grammar takes for secrets."""
    at = found.columns.index("proposed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            more = [[s for s in spans if g.best(s["value"])] if spans else [] for spans in b.column(at).to_pylist()]
            kept = [i for i in range(b.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(more, pa.list_(_SPAN))], [*(b.schema.names[i] for i in kept), "more"])

    rest = found.drop("proposed")
    return found.mapInArrow(run, ", ".join([f"{c} {t}" for c, t in rest.dtypes] + [f"more {FOUND}"]))


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank[s["kind"]].alias("b"), s["stop"].alias("c"), s["kind"].alias("d"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["d"], s["a"].cast("string"), s["c"].cast("string"))), ",")


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, the fixed spans, and those that the grammar adds (more), each with its value."""
    small_batches(docs.sparkSession)
    found = stage(found_spans(docs), "secrets")
    return inferred(found, fit(found))


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts and the digest of the fixed spans, and all spans, for each row of docs."""
    rows = secret_spans(docs)
    return rows.select(
        "doc_id",
        *[F.size(F.filter(F.col("fixed")["kind"], F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("fixed")), 256).alias("base_sha256"),
        joined(F.concat("fixed", "more")).alias("spans"),
    )
