"""Words of texts as runs of letters of one script, from code-point ranges."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: First and last code points of scripts; letters elsewhere are the script OTHER.
RANGES = (
    (0x0041, 0x024F, "latin"), (0x0370, 0x03FF, "greek"), (0x0400, 0x052F, "cyrillic"), (0x0530, 0x058F, "armenian"),
    (0x0590, 0x05FF, "hebrew"), (0x0600, 0x077F, "arabic"), (0x0900, 0x097F, "devanagari"), (0x0980, 0x09FF, "bengali"),
    (0x0B80, 0x0BFF, "tamil"), (0x0C00, 0x0C7F, "telugu"), (0x0E00, 0x0E7F, "thai"), (0x10A0, 0x10FF, "georgian"),
    (0x1100, 0x11FF, "hangul"), (0x1E00, 0x1EFF, "latin"), (0x1F00, 0x1FFF, "greek"), (0x3040, 0x30FF, "kana"),
    (0x3130, 0x318F, "hangul"), (0x3400, 0x4DBF, "han"), (0x4E00, 0x9FFF, "han"), (0xAC00, 0xD7AF, "hangul"),
    (0xF900, 0xFAFF, "han"), (0x20000, 0x2FA1F, "han"),
)
SCRIPTS = ("none", "other", *dict.fromkeys(name for _, _, name in RANGES))
_MARK = 255
BLOCK = 1 << 21


@lru_cache(maxsize=1)
def tables() -> tuple[np.ndarray, np.ndarray]:
    """Of every code point, its script (0: no letter, 255: a mark, which goes with the letter before it) and
    its lower-case form, where that is one code point."""
    script, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    for x in range(0x110000):
        category = unicodedata.category(chr(x))
        if category[0] == "M":
            script[x] = _MARK
        elif category[0] == "L":
            script[x] = 1
            small = chr(x).lower()
            if len(small) == 1:
                lower[x] = ord(small)
    for first, last, name in RANGES:
        part = script[first : last + 1]
        part[part == 1] = SCRIPTS.index(name)
    return script, lower


class Words(NamedTuple):
    """Words of a run of texts: code points (lower-cased) of the whole run, and of every word its start and end
    there and its script; ``counts`` words in each text, which starts at ``heads``."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    script: np.ndarray
    counts: np.ndarray
    heads: np.ndarray


def word_runs(texts: pa.Array) -> Iterator[Words]:
    """Words of large-string texts, run by run of about BLOCK bytes; a text is never cut."""
    kinds, lower = tables()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = memoryview(texts.buffers()[2] or b"")
    at = 0
    while at < len(texts):
        to = max(int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1, at + 1)
        raw = np.frombuffer(data[int(offsets[at]) : int(offsets[to])], np.uint8)
        before = np.append(0, np.cumsum((raw & 0xC0) != 0x80))  # code points before a byte
        heads = before[offsets[at : to + 1] - offsets[at]]
        points = np.frombuffer(bytes(raw).decode().encode("utf-32-le"), np.uint32)
        script = kinds[points]
        if (script == _MARK).any():
            head = np.zeros(len(script), bool)
            head[heads[heads < len(head)]] = True
            script = np.where((script == _MARK) & head, 0, script)
            script = script[np.maximum.accumulate(np.where(script == _MARK, 0, np.arange(len(script))))]
        cut = np.append(True, script[1:] != script[:-1])[: len(script)]
        cut[heads[heads < len(cut)]] = True
        edges = np.append(np.flatnonzero(cut), len(script))
        letters = script[edges[:-1]] != 0
        starts, ends = edges[:-1][letters], edges[1:][letters]
        yield Words(lower[points], starts, ends, script[starts], np.diff(np.searchsorted(starts, heads)), heads[:-1])
        at = to
