"""Personal data in text: e-mail addresses, IP addresses, payment cards, phone
numbers, also in disguise, reported as spans of the original text.

*Base* detectors read the text as it stands.  Then *transducers* rewrite it
while an offset map records, for every character of the rewritten text, the
source characters it stands for:

* homoglyphs: full-width and mathematical forms, other scripts' digits,
  Cyrillic and Greek letters that look Latin, odd dashes, dots and spaces;
  invisible characters vanish,
* at/dot disguises: ``name (at) host [dot] org``, ``name at host dot org``,
* spelled digits: a run of at least ``MIN_DIGITS`` number words and digits, or
  of at least ``MIN_IP`` with three ``dot`` or point joints between them.

The same detectors read the result, and what they find is mapped back to
source positions.  Every base span stays; a span found only after rewriting is
added if it overlaps no span of its kind, or covers it and more (a disguise
had cut it short).

Defined results: null and empty text have no spans.  All scans are linear, so
very long texts and very long unbroken runs are fine.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
MIN_DIGITS, MIN_IP = 7, 4

# The contract's patterns.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters that look like a Latin one, as pairs.
_LOOKALIKE = dict(zip(
    "аеорсухіјѕԁԛԝһАВЕКМНОРСТХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧοινρ",
    "aeopcyxijsdqwhABEKMHOPCTXIJSABEZHIKMNOPTYXoivp", strict=True))
_DASHES = frozenset("‐‑‒–—―−﹘﹣－")
_DOTS = frozenset("․。．｡﹒")
_INVISIBLE = frozenset("­​‌‍⁠﻿᠎")
_DOT_WORDS = "dot|punkt|point|punto"
_AT_DOT = re.compile(
    r"(?P<at>\s*+[\[({<]\s*+at\s*+[\])}>]\s*+|\s++at\s++(?=[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?:\s*+[\[({<]\s*+dot\s*+[\])}>]|\s++dot\s++|\.[A-Za-z])))"
    r"|(?P<dot>\s*+[\[({<]\s*+(?:" + _DOT_WORDS + r")\s*+[\])}>]\s*+|\s++dot\s++)", re.I)
#: What every match of ``_AT_DOT`` holds, quick to look for.
_AT_DOT_HINT = re.compile(rf"\s(?:at|dot)\s|(?:at|{_DOT_WORDS})\s*+[\])}}>]", re.I)
# The digits' names in the corpus's languages.
_SPELLED = {w: str(d) for d, names in enumerate((
    "zero oh null zéro cero", "one eins un uno", "two zwei zwo deux dos", "three drei trois tres",
    "four vier quatre cuatro", "five fünf cinq cinco", "six sechs seis", "seven sieben sept siete",
    "eight acht huit ocho", "nine neun neuf nueve")) for w in names.split()}
_NUMBER = "|".join(sorted(_SPELLED, key=len, reverse=True))
_DIGIT_RUN = re.compile(rf"(?:\bplus[\s-]++|\+\s?)?\b(?:{_NUMBER}|[0-9])(?:[\s.-]{{0,2}}(?:\bdot\b\s?)?\b(?:{_NUMBER}|[0-9]))+\b", re.I)
_JOINT = re.compile(r"\bdot\b|\.(?=\w)", re.I)
_DIGIT_ATOM = re.compile(rf"\bplus\b|{_NUMBER}|[0-9]", re.I)


def luhn(digits: str) -> bool:
    odd = digits[-1::-2]
    even = digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the contract's pattern finds them, but linear: from each ``@`` back
    over the local part (not into the last match) and on over the domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        else:
            end = max(end, at + 1)
        at = text.find("@", max(at + 1, end))


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), by start and then kind as listed in ``KINDS``."""
    found = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split(".")):
            found.append((*m.span(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((*m.span(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                found.append((*m.span(), "phone"))
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


class Mapped:
    """Rewritten text; character ``i`` stands for source ``[lo[i], hi[i])``."""

    def __init__(self, text: str):
        self.text, self.lo, self.hi = text, list(range(len(text))), list(range(1, len(text) + 1))

    def rewrite(self, edits) -> None:
        """``edits``: (start, end, [(text piece, start, end), ...]) in order."""
        text, lo, hi, at = [], [], [], 0
        for start, end, pieces in edits:
            text.append(self.text[at:start])
            lo += self.lo[at:start]
            hi += self.hi[at:start]
            for piece, a, b in pieces:
                text.append(piece)
                lo += [self.lo[a]] * len(piece)
                hi += [self.hi[b - 1]] * len(piece)
            at = end
        text.append(self.text[at:])
        lo += self.lo[at:]
        hi += self.hi[at:]
        self.text, self.lo, self.hi = "".join(text), lo, hi

    def source(self, start: int, end: int) -> tuple[int, int]:
        return self.lo[start], self.hi[end - 1]


def _plain(c: str) -> str:
    """The plain form of one character, itself if it has none."""
    if c in _INVISIBLE:
        return ""
    if c in _DASHES:
        return "-"
    if c in _DOTS:
        return "."
    if c in _LOOKALIKE:
        return _LOOKALIKE[c]
    if (d := unicodedata.digit(c, None)) is not None:
        return str(d)
    if c.isspace():
        return " "
    wide = unicodedata.normalize("NFKC", c)
    return wide if wide != c and wide.isascii() else c


class Deobfuscator:
    """Applies the three transducers; ``None`` if none of them changes a text.
    Plain forms of characters are looked up once."""

    def __init__(self):
        self.forms: dict[str, str] = {}

    def __call__(self, text: str) -> Mapped | None:
        odd = [] if text.isascii() else sorted(c for c in set(text) if not c.isascii() and self.form(c) != c)
        if not odd and not (_AT_DOT_HINT.search(text) and _AT_DOT.search(text)) and not _runs(text):
            return None
        out = Mapped(text)
        if odd:
            shape = re.compile("[" + re.escape("".join(odd)) + "]")
            out.rewrite((m.start(), m.end(), [(self.forms[m[0]], *m.span())]) for m in shape.finditer(text))
        out.rewrite(_digit_edits(out.text))
        out.rewrite((m.start(), m.end(), [("@" if m["at"] else ".", *m.span())]) for m in _AT_DOT.finditer(out.text))
        return out

    def form(self, c: str) -> str:
        if c not in self.forms:
            self.forms[c] = _plain(c)
        return self.forms[c]


_BREAKS = str.maketrans("-.,:;()", "       ")


def _runs(text: str) -> list:
    """Runs of number words and digits, long enough to be an identifier."""
    marks = "".join(["s" if w in _SPELLED else "d" if w.isdigit() else "" if w == "dot" else "-" for w in text.lower().translate(_BREAKS).split()])
    if "ss" not in marks and "sd" not in marks and "ds" not in marks:
        return []
    return [m for m in _DIGIT_RUN.finditer(text) if re.search("[^\\W\\d]", m[0]) and _long_enough(m[0])]


def _long_enough(run: str) -> bool:
    n = len(_DIGIT_ATOM.findall(run))
    return n >= MIN_DIGITS or n >= MIN_IP and len(_JOINT.findall(run)) >= 3


def _digit_edits(text: str):
    """Number words of long runs become digits; blanks inside a run vanish,
    ``dot`` and other marks stay."""
    for m in _runs(text):
        pieces = []
        for a in re.finditer(rf"\bplus\b[\s-]*|(?:{_NUMBER}|[0-9])|\bdot\b|[.+-]", m[0], re.I):
            word = a[0].lower()
            piece = "+" if word.startswith("plus") else "." if word == "dot" else _SPELLED.get(word, word)
            if piece == "-":
                continue
            pieces.append((piece, m.start() + a.start(), m.start() + a.end()))
        yield m.start(), m.end(), pieces


def find_spans(text: str | None, deobfuscate: Deobfuscator) -> tuple[list, list]:
    """(base spans, all spans) of a text, each as (start, end, kind)."""
    if not text:
        return [], []
    base = detect(text)
    mapped = deobfuscate(text)
    if mapped is None:
        return base, base
    own = {k: [(a, b) for a, b, kind in base if kind == k] for k in KINDS}
    spans = list(base)
    for a, b, kind in detect(mapped.text):
        start, end = mapped.source(a, b)
        known = own[kind]  # in order, not overlapping
        near = known[bisect_left(known, start, key=lambda s: s[1] - 1):bisect_left(known, end, key=lambda s: s[0])]
        if all(start <= s and e <= end and (s, e) != (start, end) for s, e in near):
            spans.append((start, end, kind))
    spans.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return base, spans


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def detect_pii(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: the id, ``base`` and ``spans`` as arrays of
    (start, end, kind) in code points, end exclusive."""
    kind = dict(df.dtypes)[id_col]
    span = "array<struct<start:int,end:int,kind:string>>"

    def run(batches):
        deobfuscate = Deobfuscator()
        for pdf in batches:
            found = [find_spans(t, deobfuscate) for t in pdf["text"]]
            as_rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]
            yield pd.DataFrame({id_col: pdf["id"], "base": [as_rows(b) for b, _ in found], "spans": [as_rows(s) for _, s in found]})

    rows = df.select(df[id_col].alias("id"), df[text_col].alias("text"))
    return rows.mapInPandas(run, f"`{id_col}` {kind}, base {span}, spans {span}")


def digest(spans) -> str:
    return hashlib.sha256(joined(spans).encode()).hexdigest()
