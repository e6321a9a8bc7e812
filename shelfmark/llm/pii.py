"""Personal data: fixed patterns, and more spans found by weak supervision.

Looser patterns propose candidate spans. Labelers vote on each: its shape, a gazetteer of values that
begin or end such data (bank countries, key prefixes, top-level domains), cue words before it, the
context that speaks against it, the make-up of its characters (checksums, ranges, entropy), and its
borders. The votes of all candidates of all documents are counted by kind and pattern, of which there
are few; expectation-maximisation over these counts estimates how reliable each labeler is for each
kind, starting from its reliability over all kinds, and how likely each pattern is a true span. A
logistic span classifier is then trained on these likelihoods, with measures of the candidate and of
the words around it beside its kind and votes, and decides for every candidate. A candidate that
touches a fixed-pattern span goes.

Only the classifier's fit uses a bounded sample: at most FIT candidates, those with the least hash of
votes, measures and place. The votes are counted over all documents.

Edge cases: a null or empty text has no spans; a text of any length is searched whole,
in time that grows with its length and its number of spans; a null doc_id
is kept; repeated rows and rows that share a doc_id are searched each; of candidates that overlap the
first and longest stands; with no candidate in the table nothing is trained; an empty table gives an
empty result; pii_report ignores other columns, pii_redact returns them as they are, whatever their
names.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, map_rows, small_batches, stage

BASE = ["email", "ip", "card", "phone"]
#: Kinds that candidates add; a local telephone number counts as phone.
ADDED = ["phone", "secret", "ssn", "iban", "email"]
KINDS = ["email", "ip", "card", "phone", "secret", "ssn", "iban"]

# Each search starts once in a run of characters: where the run's first start fails, so do the later ones.
_LOCAL_PART = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: Proposals by kind; each is tried only where its marker occurs.
_LOCAL = re.compile(r"(?<![0-9+(-])(?:1[ .-])?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9-])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}(?![A-Za-z0-9+/_-])")
_WRITTEN = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?(?:\[at\]|\(at\)|\{at\}) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)|\{dot\}| dot |\.) ?[A-Za-z0-9-]{2,63})+")

#: Cue words by kind.
_CUES = {
    "phone": ("tel", "phone", "call", "fax", "mobil", "cell"),
    "secret": ("token", "secret", "key", "passw", "pwd", "auth", "bearer", "api"),
    "ssn": ("ssn", "social security", "tax id"),
    "iban": ("iban", "account", "konto", "cuenta", "compte"),
    "email": ("mail", "contact", "write to"),
}
_AGAINST = ("version", "isbn", "order", "page", "section", "chapter", "commit", "sha", "http", "/")
# The lengths of bank account numbers by country.
_BANKS = {
    "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28,
    "IE": 22, "IT": 27, "LT": 20, "LU": 20, "LV": 21, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24,
}
# How issued keys and tokens begin.
_PREFIXES = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "sk_live_", "sk_test_", "pk_live_", "sk-", "xoxb-", "xoxp-", "eyJ", "hf_", "npm_", "ya29.")
_DOMAINS = ("com", "org", "net", "edu", "gov", "io", "dev", "de", "fr", "es", "uk", "eu")
LABELERS = 6
#: The most candidates that the classifier is trained on.
FIT = 20_000


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost addresses that don't overlap: from the start of what stands before an @, but not from
    before the end of the last one."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = done + len(text[done:at].rstrip(_LOCAL_PART))
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def fixed_spans(text: str) -> list[tuple[int, int, str]]:
    """The base spans, by start and then kind as listed."""
    out = []
    if "@" in text:
        out += [(a, z, "email") for a, z in emails(text)]
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], BASE.index(s[2])))


def _entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s)))


def _votes(kind: str, text: str, start: int, end: int) -> tuple[int, ...]:
    """-1, 0 or 1 from each labeler."""
    body, before, after = text[start:end], text[max(0, start - 24) : start].lower(), text[end : end + 2]
    digits = _NOT_DIGIT.sub("", body)
    known = 0
    if kind == "phone":
        ten = digits[-10:]
        shape, made = 1 if "(" in body or body.count("-") == 2 else 0, 1 if ten[0] not in "01" and ten[3] not in "01" else (0 if ten[3] not in "01" else -1)
    elif kind == "secret":
        flat = body.strip("=/-_+")
        h = _entropy(flat)
        shape, made = 1 if re.fullmatch(r"[0-9a-f]{32,}|[A-Za-z0-9+/_-]{20,}", flat) and len(digits) >= 4 else -1, 1 if h >= 3 and len(digits) >= 4 else (-1 if h < 2.5 or flat.isdigit() else 0)
        known = 1 if body.startswith(_PREFIXES) else 0
    elif kind == "ssn":
        shape, made = 1, -1 if digits[:3] in ("000", "666") or digits[0] == "9" or digits[3:5] == "00" or digits[5:] == "0000" else 1
    elif kind == "iban":
        flat = body.replace(" ", "")
        whole = "".join(str(int(c, 36)) for c in flat[4:] + flat[:4])
        shape, made = 1 if 15 <= len(flat) <= 34 else -1, 1 if int(whole) % 97 == 1 else -1
        known = 1 if _BANKS.get(flat[:2]) == len(flat) else -1
    else:
        shape, made = 1 if "[" in body or "(" in body else -1, 0
        known = 1 if body.lower().endswith(_DOMAINS) else -1
    cue = 1 if any(c in before for c in _CUES[kind]) else 0
    context = -1 if any(c in before[-12:] for c in _AGAINST) else (1 if re.search(r"[=:\"']\s*$", before) or after[:1] in "\"';" and after else 0)
    alone = 1 if (not before or before[-1] in " \n\t\"'(:=") and (not after or after[0] in " \n\t\"').,;!?") else -1
    return shape, known, cue, context, made, alone


#: What the classifier sees beside kind and votes.
MEASURES = ["length", "digits", "upper", "parts", "entropy", "own_line", "quoted", "digits_before", "long_words_before", "starts_text"]


def measures(text: str, start: int, end: int) -> list[float]:
    """Measures of a span and of what stands around it, each about 0 to 1."""
    body, before, after = text[start:end], text[max(0, start - 48) : start], text[end : end + 1]
    n = len(body)
    near = before.split()
    return [
        min(n, 64) / 64,
        sum(c.isdigit() for c in body) / n,
        sum(c.isupper() for c in body) / n,
        min(4, body.count(" ") + body.count("-") + body.count(".")) / 4,
        _entropy(body) / 6,
        float((not before or before[-1] == "\n") and after in ("", "\n")),
        float(before[-1:] in "\"'" and after in "\"'" and bool(before) and bool(after)),
        sum(c.isdigit() for c in before) / max(1, len(before)),
        min(1.0, sum(map(len, near)) / max(1, len(near)) / 12),
        float(start < 48),
    ]


def candidates(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """Proposed spans that touch no fixed one and not each other."""
    found: list[tuple[int, int, str]] = []
    if "at]" in text or "at)" in text or "at}" in text:
        found += [(m.start(), m.end(), "email") for m in _WRITTEN.finditer(text)]
    if _DIGIT.search(text):
        found += [(m.start(), m.end(), "phone") for m in _LOCAL.finditer(text)]
        found += [(m.start(), m.end(), "ssn") for m in _SSN.finditer(text)]
        found += [(m.start(), m.end(), "iban") for m in _IBAN.finditer(text)]
        found += [(m.start(), m.end(), "secret") for m in _SECRET.finditer(text)]
    starts, ends, last = [s for s, _, _ in taken], list(accumulate((e for _, e, _ in taken), max)), 0
    out = []
    for s, e, k in sorted(found, key=lambda c: (c[0], -c[1], c[2])):
        before = bisect_left(starts, e)  # the fixed spans that start before this one ends
        if s >= last and (not before or ends[before - 1] <= s):
            last = e
            out.append((s, e, k, _votes(k, text, s, e)))
    return out


#: How votes of -1, 0 and 1 are spread over false and over true spans before any is seen.
_START = np.array([[0.6, 0.3, 0.1], [0.1, 0.3, 0.6]])


def expectation_maximisation(votes: np.ndarray, count: np.ndarray, rounds: int = 60, start: np.ndarray | None = None, trust: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """votes: (patterns, labelers) of -1, 0, 1; count: how often each occurs. Returns each pattern's
    likelihood of being true, and the spread of each labeler's votes over false and true spans, (2,
    labelers, 3): one that says the same of both tells nothing, however often it is right. start: spreads
    that weigh as much as `trust` of all votes."""
    w = count / count.sum()
    hot = (votes[:, :, None] == np.array([-1, 0, 1])).astype(float)  # patterns, labelers, votes
    first = np.repeat(_START[:, None, :], votes.shape[1], axis=1) if start is None else start
    p = 1 / (1 + np.exp(-votes.sum(axis=1)))
    spread = first
    for _ in range(rounds):
        prior = float(np.clip((w * p).sum(), 0.02, 0.98))
        share = np.stack([w * (1 - p), w * p])
        spread = (np.einsum("cp,pjv->cjv", share, hot) + trust * first) / (share.sum(axis=1) + trust)[:, None, None]
        score = math.log(prior / (1 - prior)) + np.einsum("pjv,jv->p", hot, np.log(spread[1] / spread[0]))
        p = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
    return p, spread


def reliability(spread: np.ndarray) -> np.ndarray:
    """How often a labeler says yes of true and no of false spans, on average."""
    return (spread[1, :, 2] + spread[0, :, 0]) / 2


def likelihoods(code: np.ndarray, count: np.ndarray) -> tuple[dict[int, float], dict[str, np.ndarray]]:
    """Of each pattern that it is a true span, and each kind's reliabilities. Kinds start from the spreads
    over all of them, so a rare kind keeps close to these."""
    votes = np.stack([code // 3 ** (LABELERS - 1 - j) % 3 - 1 for j in range(LABELERS)], axis=1).astype(float)
    kind = code // 3**LABELERS
    _, pooled = expectation_maximisation(votes, count)
    out, reliable = {}, {}
    for k in np.unique(kind):
        rows = kind == k
        p, spread = expectation_maximisation(votes[rows], count[rows], start=pooled, trust=min(1.0, 50 / count[rows].sum()) + 0.02)
        out |= dict(zip(code[rows].tolist(), p.tolist(), strict=True))
        reliable[KINDS[int(k)]] = reliability(spread)
    return out, reliable


def _features(code: int, around: list[float]) -> list[float]:
    hot, votes = [0.0] * len(KINDS), []
    for _ in range(LABELERS):
        votes.append(float(code % 3 - 1))
        code //= 3
    hot[code] = 1.0
    return [1.0, *hot, *reversed(votes), *around]


def train(x: np.ndarray, target: np.ndarray, decay: float = 1e-3, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic model of soft targets, by Newton's method."""
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        slope = x.T @ (target - p) / len(x) - decay * beta
        bend = (x * (p * (1 - p))[:, None]).T @ x / len(x) + decay * np.eye(x.shape[1])
        step = np.linalg.solve(bend, slope)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return beta


SPAN = "struct<start:int, stop:int, kind:string>"
FIXED = f"array<{SPAN}>"
PROPOSED = "array<struct<start:int, stop:int, kind:string, pattern:int, around:array<double>>>"


def _code(kind: str, votes: tuple[int, ...]) -> int:
    n = KINDS.index(kind)
    for v in votes:
        n = n * 3 + v + 1
    return n


def found_spans(docs: DataFrame, fixed: str = "fixed", proposed: str = "proposed", keep: bool = True) -> DataFrame:
    """docs (without text, unless keep) with both lists of spans of each row's text."""
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string())])
    more = pa.struct([*span, ("pattern", pa.int32()), ("around", pa.list_(pa.float64()))])
    at = docs.columns.index("text")
    kept = [i for i in range(len(docs.columns)) if keep or i != at]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, new = [], []
            for t in b.column(at).to_pylist():
                spans = fixed_spans(t or "")
                own.append([{"start": s, "stop": e, "kind": k} for s, e, k in spans])
                new.append([{"start": s, "stop": e, "kind": k, "pattern": _code(k, v), "around": measures(t, s, e)} for s, e, k, v in candidates(t or "", spans)])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(own, pa.list_(span)), pa.array(new, pa.list_(more))], [*(b.schema.names[i] for i in kept), fixed, proposed])

    more_fields = T.StructType.fromDDL(f"{fixed} {FIXED}, {proposed} {PROPOSED}")
    return map_rows(docs, run, T.StructType([*(docs.schema.fields[i] for i in kept), *more_fields]))


def classifier(found: DataFrame, proposed: str = "proposed", most: int = FIT) -> np.ndarray | None:
    """The span classifier's weights, or None if there is no candidate. At most 7 * 3**6 patterns exist."""
    spans = found.select(F.explode(proposed).alias("s")).select("s.pattern", "s.around", "s.start")
    counts = spans.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()
    if not counts:
        return None
    target, _ = likelihoods(np.array([r[0] for r in counts]), np.array([r[1] for r in counts], float))
    rows = spans.orderBy(F.xxhash64("pattern", "around", "start"), "pattern", "start").limit(most).collect()
    return train(np.array([_features(r["pattern"], r["around"]) for r in rows]), np.array([target[r["pattern"]] for r in rows]))


def accepted(beta: np.ndarray | None, proposed: Column) -> Column:
    """The spans of proposed that the classifier takes."""
    plain = lambda s: F.struct(s["start"].alias("start"), s["stop"].alias("stop"), s["kind"].alias("kind"))
    if beta is None:
        return F.transform(F.filter(proposed, lambda s: F.lit(False)), plain)
    kinds, votes, around = np.split(beta[1:], [len(KINDS), len(KINDS) + LABELERS])

    def score(s: Column) -> Column:
        out = F.lit(float(beta[0])) + F.element_at(F.array(*map(F.lit, kinds.tolist())), (F.call_function("div", s["pattern"], F.lit(3**LABELERS)) + 1).cast("int"))
        for j, w in enumerate(votes.tolist()):
            out = out + F.lit(w) * (F.call_function("div", s["pattern"], F.lit(3 ** (LABELERS - 1 - j))) % 3 - 1)
        return out + F.aggregate(F.zip_with(s["around"], F.array(*map(F.lit, around.tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)

    return F.transform(F.filter(proposed, lambda s: score(s) >= 0), plain)


def joined(spans: Column) -> Column:
    """kind:start:end by start, then kind as listed."""
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), rank[s["kind"]].alias("b"), s["stop"].alias("c"), s["kind"].alias("d"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", s["d"], s["a"].cast("string"), s["c"].cast("string"))), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts and the digest of the fixed spans, and all spans, for each row of docs."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stage(found_spans(slim, keep=False), "spans")
    more = accepted(classifier(found), F.col("proposed"))
    return found.select(
        "doc_id",
        *[F.size(F.filter(F.col("fixed")["kind"], F.lit(k).__eq__)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("fixed")), 256).alias("base_sha256"),
        joined(F.concat("fixed", more)).alias("spans"),
    )


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Every span replaced by its kind in brackets; of spans that overlap, the first and longest."""
    out, at = [], 0
    for s, e, k in sorted(spans, key=lambda x: (x[0], -x[1])):
        if s >= at:
            out += [text[at:s], f"[{k.upper()}]"]
        at = max(at, e)  # the rest of an overlapped span goes with it
    return "".join([*out, text[at:]])


def pii_redact(docs: DataFrame) -> DataFrame:
    """docs with the spans of text replaced and n_chars, where there is one, brought up to date. The texts
    are searched once: they are written with their spans."""
    small_batches(docs.sparkSession)
    fixed, proposed, spans = (free_name(docs, n) for n in ("_fixed", "_proposed", "_spans"))
    found = stage(found_spans(docs.withColumn("text", F.col("text").cast("string")), fixed, proposed), "spans")
    rows = found.withColumn(spans, F.concat(fixed, accepted(classifier(found, proposed), F.col(proposed)))).drop(fixed, proposed)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = [t and redact(t, [(x["start"], x["stop"], x["kind"]) for x in own]) if own else t for t, own in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist(), strict=True)]
            kept = [pa.array(text, pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(kept, b.schema.names[:-1])

    out = map_rows(rows, run, rows.drop(spans).schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
