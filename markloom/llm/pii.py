"""Personal data, also where it is disguised, with spans in the original text.

Identifiers are first found in the text as it is.  Texts that show a sign of disguise then pass a chain of
small transducers, each of which rewrites a text and keeps, for every character of its output, the span of
source characters it came from: look-alike letters, digits and signs become ASCII and zero-width characters
go; spelled digits in a row become digits and a ``plus`` before them a sign; ``(at)`` and ``[dot]`` become
signs; so do `` dot `` in the host behind an ``@`` and between digits, and `` at `` before a host with a
disguised dot (before a host with plain dots it is left alone, as in "look at example.com").
Identifiers found in the rewritten text are mapped back; those that do not lie inside a plain span of their
kind are added.  Texts without such a sign (most) are done after the first step.

Everything happens inside a row and a span never leaves its text, so no shuffle is needed.

Defined cases: null texts count as empty; repeated rows get a row each; an empty table gives no rows; other
columns are ignored.  Places count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.llm.common import body

KINDS = ("email", "ip", "card", "phone")
#: The plain forms of the identifiers.
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: Letters, digits and signs that look like the ASCII character before them.
LOOK_ALIKES = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "еҽ", "h": "һ", "i": "іı", "j": "ј", "k": "к", "l": "ӏ", "m": "м", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ",
    "s": "ѕ", "t": "т", "u": "υս", "v": "ν", "w": "ԝѡ", "x": "хχ", "y": "уү", "A": "АΑ", "B": "ВΒ", "C": "С", "E": "ЕΕ", "H": "НΗ", "I": "ІΙ", "K": "КΚ",
    "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "S": "Ѕ", "T": "ТΤ", "X": "ХΧ", "Y": "ҮΥ", ".": "․。｡", "-": "‐‑‒–−﹣", "@": "﹫", "+": "﬩",
}
DROPPED = "​‌‍⁠﻿­"
#: Spelled digits in English, French, Spanish and German.
SPELLED = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
}
LEAST_SPELLED = 4

_SAME = {ord(x): a for a, others in LOOK_ALIKES.items() for x in others} | {0xFF01 + i: chr(0x21 + i) for i in range(94)} | dict.fromkeys(map(ord, DROPPED), "")
_ODD = re.compile("[" + "".join(re.escape(chr(c)) for c in _SAME) + "]")
_DIGIT_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_NUMBER = re.compile(rf"(?i)(?<![^\W\d_])(?:(?:{_DIGIT_WORD}|[0-9])[\x20,.-]{{0,2}}){{{LEAST_SPELLED - 1},}}(?:{_DIGIT_WORD}|[0-9])(?![^\W\d_])")
_ONE_DIGIT = re.compile(rf"(?i){_DIGIT_WORD}")
_HAS_SPELLED = re.compile(rf"(?i)(?<![^\W\d_])(?:{_DIGIT_WORD})[\x20,.-]{{1,2}}(?:{_DIGIT_WORD}|[0-9])(?![^\W\d_])")
_BRACKETED = re.compile(r"(?i)\x20?[(\[{<]\x20?(at|dot|@|\.)\x20?[)\]}>]\x20?")
_PLUS = re.compile(r"(?i)(?<![^\W\d_])(?:plus|más|mas)[\x20-]{1,2}$")
_SPOKEN = re.compile(r"(?i)(?<![A-Za-z0-9])[A-Za-z0-9._%+-]+(\x20at\x20)([A-Za-z0-9-]+(?:(?:\.|\x20dot\x20)[A-Za-z0-9-]+)+)")
_HOST = re.compile(r"(?i)(?<=@)[A-Za-z0-9-]+(?:(?:\.|\x20dot\x20)[A-Za-z0-9-]+)+")
_POINT = re.compile(r"(?i)(?<=[0-9])\x20dot\x20(?=[0-9])")
_DOT = re.compile(r"(?i)\x20dot\x20")
_HINT = re.compile(r"(?i)[(\[{<]\x20?(?:at|dot|@|\.)\x20?[)\]}>]|\x20dot\x20")

Piece = tuple[str, list[int], list[int]]


def _rewritten(given: Piece, changes: list[tuple[int, int, str]]) -> Piece:
    """Replace stretches of a text; each new character stands for its whole stretch."""
    text, starts, ends = given
    out, first, last, at = [], [], [], 0
    for a, b, new in changes:
        out.append(text[at:a])
        first += starts[at:a]
        last += ends[at:a]
        out.append(new)
        first += [starts[a]] * len(new)
        last += [ends[b - 1]] * len(new)
        at = b
    out.append(text[at:])
    return "".join(out), first + starts[at:], last + ends[at:]


def look_alikes(given: Piece) -> Piece:
    return _rewritten(given, [(m.start(), m.end(), _SAME[ord(m[0])]) for m in _ODD.finditer(given[0])])


def spelled_digits(given: Piece) -> Piece:
    changes = []
    for m in _NUMBER.finditer(given[0]):
        if _ONE_DIGIT.search(m[0]):
            at = m.start()
            words = list(re.finditer(rf"(?i){_DIGIT_WORD}|[0-9]", m[0]))
            if plus := _PLUS.search(given[0], max(at - 7, 0), at):
                changes.append((plus.start(), at, "+"))
            for k, w in enumerate(words):
                end = words[k + 1].start() if k + 1 < len(words) else w.end()
                changes.append((at + w.start(), at + end, SPELLED.get(w[0].lower(), w[0])))
    return _rewritten(given, changes)


def signs(given: Piece) -> Piece:
    sign = {"at": "@", "dot": ".", "@": "@", ".": "."}
    given = _rewritten(given, [(m.start(), m.end(), sign[m[1].lower()]) for m in _BRACKETED.finditer(given[0])])
    given = _rewritten(given, [(*m.span(), ".") for m in _POINT.finditer(given[0])])
    text, starts, ends = given
    disguised = lambda i: text[i] == "." and ends[i] - starts[i] > 1
    ats = [m.span(1) for m in _SPOKEN.finditer(text) if _DOT.search(m[2]) or any(map(disguised, range(*m.span(2))))]
    given = _rewritten(given, [(a, b, "@") for a, b in ats])
    hosts = [(m.start(), d) for m in _HOST.finditer(given[0]) for d in _DOT.finditer(m[0])]
    return _rewritten(given, [(at + d.start(), at + d.end(), ".") for at, d in hosts])


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _valid(kind: str, match: str) -> bool:
    if kind == "ip":
        return all(len(part.lstrip("0")) <= 3 and int(part) <= 255 for part in match.split("."))
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "card":
        return 16 <= len(digits) <= 19 and _luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def plain_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind number, start, end)`` of the identifiers in a text as it is."""
    found = []
    for number, kind in enumerate(KINDS):
        if kind == "email" and "@" not in text or kind == "phone" and "+" not in text:
            continue
        found += [(number, m.start(), m.end()) for m in PATTERNS[kind].finditer(text) if _valid(kind, m[0])]
    return found


def all_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Plain spans, and all spans with those that only show after deobfuscation."""
    base = plain_spans(text)
    odd = not text.isascii() and _ODD.search(text)
    if not (odd or _HINT.search(text) or _HAS_SPELLED.search(text)):
        return base, base
    piece: Piece = (text, list(range(len(text))), list(range(1, len(text) + 1)))
    for transducer in (look_alikes, spelled_digits, signs):
        piece = transducer(piece)
    more = []
    for kind, a, b in plain_spans(piece[0]):
        start, end = piece[1][a], piece[2][b - 1]
        if not any(k == kind and s <= start and end <= e for k, s, e in base + more):
            more.append((kind, start, end))
    return base, sorted(base + more)


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text")
        for at in range(0, batch.num_rows, 256):
            rows = [all_spans(t) for t in texts.slice(at, 256).to_pylist()]
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in range(len(KINDS))]
            lists = [pa.array([_listed(r[i]) for r in rows], pa.string()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([ids.slice(at, 256), *counts, *lists], ["doc_id", *(f"n_{k}" for k in KINDS), "base", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (plain ones), ``base`` and ``spans`` (``kind:start:end`` by
    kind, then start, comma-joined) of every document."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), body().alias("text"))
    return texts.mapInArrow(_scan, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")
