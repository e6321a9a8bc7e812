"""Token ids of whole texts, with a bounded memory of the units already encoded.

A byte-level BPE whose tokens never hold a blank but at their start doesn't join characters across
the start of a blank run, so a text may be cut before every space or line feed and the ids of the
pieces joined. Where the vocabulary drops blanks and lower-cases, pieces are kept in lower case,
without blanks, and without a stop or comma that ends a word. Texts with any other blank, with two
blanks in a row, or with the string of an added token (such as <|endoftext|>, which the tokenizers
library reads as that token) go to the tokenizer whole, and so does every text where the vocabulary
is of another kind. Pieces repeat far more often than texts do. A new piece that is a word of Latin
letters, punctuation, or one after the other is given to the vocabulary's merges part by part, where
the vocabulary is known to part it there; any other goes through the tokenizer.

The memory is bounded by its bytes, and a unit over LONGEST characters is encoded and not kept: texts
without blanks, as in Chinese or Japanese or encoded data, are one unit each and don't repeat.

Edge cases: a null or empty text has no ids; texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array

#: What sends a text to the tokenizer whole: two blanks in a row, and other blanks, in ASCII and beyond.
_BLANKS = ["  ", "\n\n", " \n", "\n ", "\t", "\r", "\f", "\v", "\0", "\x1c", "\x1d", "\x1e", "\x1f"]
_WIDE = re.compile("[\x85\xa0\u1680\u180e\u2000-\u200f\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")


def _odd(t: str) -> bool:
    return any(map(t.__contains__, _BLANKS)) or (not t.isascii() and bool(_WIDE.search(t)))


#: Letters whose lower case depends on their neighbours or has two letters.
_CASES = re.compile("[Σİẞŉǰΐΰ]|'")
#: A stop or comma that ends a word; patterns that begin with the mark itself are searched for many times faster.
_STOP, _COMMA = re.compile(r"\.(?=[ \n]|$)(?<=[a-z]\.)"), re.compile(r",(?=[ \n]|$)(?<=[a-z],)")


def cut_stops(t: str) -> str:
    """A lower-case text with a blank before each stop or comma that ends a word."""
    return _COMMA.sub(" ,", _STOP.sub(" .", t))


#: Fixed value: the pattern by which a lower-casing public vocabulary parts a text.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A word and what follows it, in characters that any version of Unicode calls letters or punctuation.
_PUNCTUATION = r"!-&(-/:-@\[-`{-~"
_FOLDED = re.compile(f"([a-zß-öø-ÿ]+)?([{_PUNCTUATION}]+)?")
_BLANK_LED = re.compile(f"(\n)?( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)?( ?[{_PUNCTUATION}]+)?")


def _parts(spec: dict) -> re.Pattern | None:
    """What parts a unit as the vocabulary does, where that is known."""
    before = spec.get("pre_tokenizer") or {}
    steps = before.get("pretokenizers") or [before]
    if steps[-1].get("type") != "ByteLevel" or spec["model"].get("dropout"):
        return None
    if len(steps) == 1 and not spec.get("normalizer") and steps[0].get("use_regex", True):
        return _BLANK_LED
    if len(steps) == 2 and steps[0].get("pattern") == {"Regex": _WORDS} and steps[0].get("behavior") == "Removed" and steps[0].get("invert") and not steps[1].get("use_regex", True):
        return _FOLDED
    return None


def _byte_letters() -> dict[int, str]:
    """Each byte as byte-level vocabularies write it: itself where it is seen, else the next free letter."""
    out, free = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 255 and b != 173:
            out[b] = chr(b)
        else:
            out[b], free = chr(free), free + 1
    return out


_LETTERS = _byte_letters()


def _cuts_at_blanks(spec: dict) -> bool:
    """Whether a vocabulary is known to give the same ids for a text cut before its single blanks."""

    def kinds(step: dict | None) -> set[str]:
        if not step:
            return set()
        more = step.get("pretokenizers") or step.get("normalizers")
        return set().union(*map(kinds, more)) if more else {step["type"]}

    def plain(step: dict | None) -> bool:
        if not step:
            return True
        return not step.get("add_prefix_space", False) and all(map(plain, step.get("pretokenizers") or []))

    # a blank, as bytes are written in such a vocabulary, after something else; blanks alone, the no-break
    # space too, are joined only in texts that go whole
    inside = re.compile("(?!^(?:\u0120|\u010a|\u00c2\u0142)+$)^.*[^\u0120\u010a][\u0120\u010a]")
    return (
        spec["model"].get("type") == "BPE"
        and kinds(spec.get("pre_tokenizer")) <= {"ByteLevel", "Split"}
        and "ByteLevel" in kinds(spec.get("pre_tokenizer"))
        and kinds(spec.get("normalizer")) <= {"NFC", "Replace", "Lowercase"}
        and plain(spec.get("pre_tokenizer"))
        and not any(t.get("normalized") or t.get("single_word") for t in spec.get("added_tokens") or [])
        and not any(inside.search(t) for t in spec["model"]["vocab"])
    )


#: Longer units are not kept, and the kept ones are let go when they take so many bytes.
LONGEST, MOST_BYTES = 64, 192 << 20
#: What a unit takes beside its two objects: its place in the table, which is a third empty and is doubled.
_PLACE = 150


class _Units(dict):
    """The units' ids; a new unit is encoded when it is asked for. n_bytes: what the kept ones take."""

    def __init__(self, encode):
        self.encode = encode
        self.n_bytes = 0

    def __missing__(self, unit: str) -> bytes:
        ids = self.encode(unit)
        if len(unit) <= LONGEST:
            self[unit] = ids
            self.n_bytes += sys.getsizeof(unit) + sys.getsizeof(ids) + _PLACE
        return ids

    def empty(self) -> None:
        self.clear()
        self.n_bytes = 0


class UnitTokenizer:
    """ids(texts) gives each text's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, most: int = MOST_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        spec = json.loads(self.tok.to_str())
        self.folds = "Lowercase" in json.dumps(spec.get("normalizer"))
        self.marks = [t["content"] for t in spec.get("added_tokens") or []]
        self.whole = not _cuts_at_blanks(spec)
        self.parts, self.model = _parts(spec), self.tok.model
        self.seen = _Units(self._unit)
        self.most = most

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _merged(self, letters: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def _unit(self, unit: str) -> bytes:
        if self.parts and unit.isascii() and unit.isalpha() and unit.islower():
            return self._merged(unit)  # one part under either pattern, its bytes written as themselves
        found = self.parts and self.parts.fullmatch(unit)
        parts = [p for p in found.groups() if p] if found else []
        if len(parts) > 1:
            return b"".join(map(self.seen.__getitem__, parts))
        if parts:
            return self._merged(unit.encode().decode("latin-1").translate(_LETTERS))
        return array("I", self.tok.encode(unit, add_special_tokens=False).ids).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for t in texts:
            if not t:
                out.append(b"")
            elif self.whole or any(m in t for m in self.marks) or _odd(t):
                out.append(self._encode([t])[0])
            else:
                if self.folds and not _CASES.search(t) and (t.isascii() or unicodedata.is_normalized("NFC", t)):
                    units = cut_stops(t.lower()).split()
                else:
                    units = t.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")
                if self.seen.n_bytes > self.most:
                    self.seen.empty()
                out.append(b"".join(map(self.seen.__getitem__, units)))
        return out


_KEPT: dict[str, UnitTokenizer] = {}


def tokenizer(path: str) -> UnitTokenizer:
    """One for each vocabulary in a worker process; it outlives tasks."""
    if path not in _KEPT:
        _KEPT[path] = UnitTokenizer(path)
    return _KEPT[path]


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
