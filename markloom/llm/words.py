"""Vectorised word hashing of Arrow text columns, for use inside ``mapInArrow`` tasks.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; as UTF-8 never uses those bytes inside
a longer character, byte runs and character runs are the same.  Every word gets a 64-bit hash: a
polynomial over its bytes from prefix sums modulo 2**64, mixed afterwards.  Equal words hash equally on
every machine; work goes block by block, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK, RELEASE_BYTES = 1 << 20, 8 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _VALUES.copy()
_LOWER[65:91] = _VALUES[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes between words of letters and digits; A-Z count as letters, bytes above 127 too.
_MARKS = np.ones(256, bool)
_MARKS[128:] = _MARKS[48:58] = _MARKS[65:91] = _MARKS[97:123] = False
_POWERS: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def released(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The same work on batches, with freed memory given back to the system between them: workers live on
    through later stages, and several share an executor's memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        seen, last = 0, 0
        for out in work(batches):
            yield out
            seen += out.nbytes
            if seen - last > RELEASE_BYTES:
                last = seen
                _give_back(trim)
        _POWERS.clear()
        _give_back(trim)

    return run


def _give_back(trim) -> None:
    pa.default_memory_pool().release_unused()
    if trim:
        trim(0)


def joined(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of ``k`` consecutive entries, by their start."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = mix(out * _BASE + hashes[i : i + n])
    return out


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n > len(_POWERS.get("up", ())):
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            row = np.full(n, base, np.uint64)
            row[0] = 1
            _POWERS[name] = np.cumprod(row, dtype=np.uint64)
    return _POWERS["up"], _POWERS["down"]


def _block(data: np.ndarray, heads: np.ndarray, values: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a block and their number in each text; ``heads`` are the starts of its texts."""
    word = ~breaks[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    inner = heads[heads < len(data)]
    first[inner] = word[inner]
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:]
    last[inner[inner > 0] - 1] = word[inner[inner > 0] - 1]
    ends = np.flatnonzero(last) + 1
    up, down = _powers(max(len(data), BLOCK))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return hashes, np.diff(np.searchsorted(starts, np.append(heads, len(data))))


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    """The column as large strings, null counting as empty."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def token_blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``word_blocks`` for lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``: punctuation parts words too."""
    return word_blocks(texts, True, _MARKS)


def word_blocks(texts: pa.Array, lower: bool = False, breaks: np.ndarray = _SPACE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes of runs of texts with the number of words in each text; ``lower`` treats A-Z as a-z."""
    values = _LOWER if lower else _VALUES
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        a = int(offsets[at])
        to = max(int(np.searchsorted(offsets, a + BLOCK, "right")) - 1, at + 1)
        b = int(offsets[to])
        if b - a <= BLOCK:
            yield _block(data[a:b], offsets[at:to] - a, values, breaks)
        else:
            parts = []
            while a < b:
                cut = min(b, a + BLOCK)
                while cut < b and not breaks[data[cut]]:
                    cut += 1
                parts.append(_block(data[a:cut], np.zeros(1, np.int64), values, breaks)[0])
                a = cut
            one = np.concatenate(parts)
            yield one, np.array([len(one)])
        at = to


def word_hashes(texts: pa.Array, lower: bool = False) -> Iterator[np.ndarray]:
    """Hashes of each text's words in order."""
    for hashes, counts in word_blocks(texts, lower):
        yield from np.split(hashes, np.cumsum(counts)[:-1])
