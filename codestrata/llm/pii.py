"""Personal data in whole texts, with an offset-preserving deobfuscation.

Base spans come from the text as it is: e-mail addresses, IPv4 addresses, payment cards (Luhn) and phone numbers,
leftmost and non-overlapping per kind; what fails its check is dropped.  For disguised identifiers four transducers
rewrite the text - look-alike characters, spelled digits, at/dot in brackets and entities, bare at/dot words around
whatever at they left - and each keeps the source range of every character it writes.  The same detectors run over the rewritten text; spans that use a rewritten character are mapped back
to the source and added, unless they lie within a base span of the kind.

Offsets are code points, ends exclusive.  Null text counts as empty: no spans.  Each row is handled for itself, so repeated
ids and texts give repeated results.  Detectors take time in proportion to the text, whatever it holds.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, slices

KINDS = ("email", "ip", "card", "phone")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A run of digits fails or matches from its first digit, so no other start needs a try.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

# Letters of other scripts that look like Latin ones.
LOOK_ALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T",
    "У": "Y", "Х": "X", "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q",
    "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y",
    "Χ": "X", "α": "a", "ι": "i", "ν": "v", "ο": "o", "ρ": "p", "υ": "u",
}
# Characters without width.
NO_WIDTH = "­​‌‍⁠﻿"
DIGITS = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True))

# Letters of the table, full-width forms, decimal digits of any script, characters without width.
_ODD = re.compile(f"[{''.join(LOOK_ALIKES)}{NO_WIDTH}！-～]|(?![0-9])\\d")
_SPELLED = "(?:" + "|".join(DIGITS) + ")"
_RUN = rf"(?:\bplus[ -]+)?\b{_SPELLED}(?:(?:[ -]+|[ ]+(?:dot|point)[ ]+){_SPELLED})+\b"
_SPELLED_RUN = re.compile(rf"(?i){_RUN}")
_SPELLED_PART = re.compile(rf"(?i)(?P<plus>plus[ -]+)|(?P<digit>{_SPELLED})|(?P<dot>[ ]+(?:dot|point)[ ]+)|[ -]+")
# Disguised signs that are rewritten wherever they stand, and the bare words, which count only around an at.
_AT_SIGN = r"(?:[\[({<][ ]*(?:at|@)[ ]*[\])}>]|&#64;|&commat;)"
_DOT_SIGN = r"(?:[\[({<][ ]*(?:dot|\.)[ ]*[\])}>]|&#46;|&period;)"
_DOT_WORD = "[ ]{1,3}dot[ ]{1,3}"
_DOT_WORD_END = re.compile(rf"(?i){_DOT_WORD}$")
_SIGNS = re.compile(rf"(?i)[ ]?(?:(?P<at>{_AT_SIGN})|{_DOT_SIGN})[ ]?")
_AT = re.compile(r"(?i)(?<=[A-Za-z0-9._%+-])@(?=[A-Za-z0-9-])|(?<=[A-Za-z0-9])[ ]{1,3}at[ ]{1,3}(?=[A-Za-z0-9-])")
# The word itself is no part of a host: "at noon dot dot".
_HOST = re.compile(rf"(?i)[A-Za-z0-9-]++(?:(?:\.|{_DOT_WORD}(?!dot\b))[A-Za-z0-9-]++)++")
_DOT = re.compile(rf"(?i){_DOT_WORD}|\.")
# Whatever a transducer can rewrite in an ASCII text: bare words need a dot that is a word or rewritten.
_HINT = re.compile(rf"(?i){_AT_SIGN}|{_DOT_SIGN}|{_DOT_WORD}|{_RUN}")


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return sum(values[0::2] + [2 * d - 9 * (d > 4) for d in values[1::2]]) % 10 == 0


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            done = domain.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str):
    for m in IP.finditer(text):
        parts = (p.lstrip("0") for p in m[0].split("."))
        if all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts):
            yield m.span()


def _cards(text: str):
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                yield m.span()


DETECTORS = dict(zip(KINDS, (_emails, _ips, _cards, _phones), strict=True))


class Rewritten:
    """A text with, for each character, the source range it stands for and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start = np.arange(len(text))
        self.end = self.start + 1
        self.changed = np.zeros(len(text), bool)

    def replace(self, edits) -> None:
        """Put each ``(start, end, new)`` in place; edits come in order and don't overlap."""
        text, starts, ends, changed, at = [], [], [], [], 0
        for a, b, new in edits:
            if not new and b < len(self.text):  # what is left out marks the character after it
                self.changed[b] = True
            text += [self.text[at:a], new]
            starts += [self.start[at:a], np.full(len(new), self.start[a])]
            ends += [self.end[at:a], np.full(len(new), self.end[b - 1])]
            changed += [self.changed[at:a], np.ones(len(new), bool)]
            at = b
        if text:
            self.text = "".join([*text, self.text[at:]])
            self.start, self.end = np.concatenate([*starts, self.start[at:]]), np.concatenate([*ends, self.end[at:]])
            self.changed = np.concatenate([*changed, self.changed[at:]])


def look_alikes(text: str):
    for m in _ODD.finditer(text):
        c = m[0]
        if c in NO_WIDTH:
            yield m.start(), m.end(), ""
        elif c in LOOK_ALIKES:
            yield m.start(), m.end(), LOOK_ALIKES[c]
        elif "！" <= c <= "～":
            yield m.start(), m.end(), chr(ord(c) - 0xFEE0)
        else:
            yield m.start(), m.end(), str(int(c))


def spelled_digits(text: str):
    for run in _SPELLED_RUN.finditer(text):
        for m in _SPELLED_PART.finditer(text, run.start(), run.end()):
            kind = m.lastgroup
            yield m.start(), m.end(), "+" if kind == "plus" else DIGITS[m[0].lower()] if kind == "digit" else "." if kind == "dot" else ""


def signs(text: str):
    for m in _SIGNS.finditer(text):
        yield m.start(), m.end(), "@" if m["at"] else "."


def _local_start(text: str, end: int, floor: int) -> int:
    """Start of the local part that ends at ``end``: words joined by dots, in signs or as words."""
    at = end
    while True:
        while at > floor and text[at - 1] in LOCAL:
            at -= 1
        joint = _DOT_WORD_END.search(text, max(floor, at - 9), at)
        if at == end or not joint or joint.start() <= floor or text[joint.start() - 1] not in LOCAL:
            return at
        at = end = joint.start()


def bare_words(text: str, changed: np.ndarray):
    """Edits of bare words around each at; a bare at needs a dot, on either side, that is a word or was rewritten."""
    floor = 0
    for m in _AT.finditer(text):
        host = _HOST.match(text, m.end())
        if not host or m.start() <= floor:
            continue
        start = _local_start(text, m.start(), floor)
        dots = [*_DOT.finditer(text, start, m.start()), *_DOT.finditer(text, host.start(), host.end())]
        words = [d for d in dots if d[0] != "."]
        if m[0] != "@" and not words:
            # Rewritten numbers ("at one dot two") are no host.
            last = text[max(text.rfind(".", host.start(), host.end()), host.start()) : host.end()]
            if not any(changed[d.start()] for d in dots) or not any(c.isalpha() for c in last):
                continue
        edits = [(d.start(), d.end(), ".") for d in words]
        if m[0] != "@":
            edits.append((m.start(), m.end(), "@"))
        yield from sorted(edits)
        floor = host.end()


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    return {kind: list(found(text)) for kind, found in DETECTORS.items()}


def disguised_spans(text: str, base: dict[str, list[tuple[int, int]]]) -> dict[str, list[tuple[int, int]]]:
    """Spans that only the rewritten text shows, mapped to the source."""
    added: dict[str, list[tuple[int, int]]] = {kind: [] for kind in KINDS}
    if not (_HINT.search(text) or (not text.isascii() and _ODD.search(text))):
        return added
    new = Rewritten(text)
    for transducer in (look_alikes, spelled_digits, signs):
        new.replace(transducer(new.text))
    new.replace(bare_words(new.text, new.changed))
    touched = np.concatenate([[0], np.cumsum(new.changed)])
    for kind, found in DETECTORS.items():
        taken, k = base[kind], 0
        for a, b in found(new.text):
            if touched[b] == touched[a]:
                continue
            start, end = int(new.start[a]), int(new.end[b - 1])
            while k < len(taken) and taken[k][1] <= start:
                k += 1
            if k == len(taken) or not taken[k][0] <= start < end <= taken[k][1]:
                added[kind].append((start, end))
    return added


def told(spans: dict[str, list[tuple[int, int]]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind in KINDS for a, b in sorted(spans[kind]))


def masked(text: str, spans: dict[str, list[tuple[int, int]]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named after the first."""
    out, at = [], 0
    for a, b, kind in sorted((a, b, kind) for kind in KINDS for a, b in spans[kind]):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), mask: bool = False) -> DataFrame:
    """``keep`` columns, base counts by kind, the digest of the base spans and all spans; with ``mask`` the masked text too.

    The masked text of a null text is empty.
    """
    rows = documents(docs, *keep, text)
    rows = rows.toDF(*[f"k{i}" for i in range(len(keep))], "text")
    kept = [f.name for f in rows.schema.fields[:-1]]
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]])
    out = "".join(f", n_{k} long" for k in KINDS) + ", base_sha256 string, spans string" + (", masked string" if mask else "")

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches, "text"):
            columns: list[list] = [[] for _ in range(len(KINDS) + 2 + mask)]
            for text in batch.column(len(kept)).to_pylist():
                base = base_spans(text)
                more = disguised_spans(text, base)
                spans = {kind: base[kind] + more[kind] for kind in KINDS}
                row = [*(len(base[k]) for k in KINDS), hashlib.sha256(told(base).encode()).hexdigest(), told(spans)]
                for column, value in zip(columns, [*row, masked(text, spans)] if mask else row, strict=True):
                    column.append(value)
            arrays = [batch.column(i) for i in range(len(kept))]
            arrays += [pa.array(c, pa.int64() if i < len(KINDS) else pa.string()) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*kept, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", *(["masked"] if mask else [])])

    found = rows.mapInArrow(run, schema + out)
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], *found.columns[len(keep) :])
