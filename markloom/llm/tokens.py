"""Token ids of whole texts, each distinct word of a block handed to the tokenizer once.

Texts are split at ASCII white space, which the tokenizers used here drop, so ids of a text are the ids of
its parts in order.  Arrow dictionary-encodes the parts of a block; Latin words are lower-cased and parted
from trailing punctuation, and words a worker has met before come from a memory of bounded size: words met
since it was last half full, and those met before that.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters that lower-casing maps one to one and NFC leaves alone, then punctuation other than an apostrophe.
SIMPLE = r"^(?P<word>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<rest>[!-&(-/:-@\[-`{-~]*)$"
#: Bytes of either half of the memory of words; what an entry takes besides its letters and ids.
REMEMBERED, ENTRY = 32 << 20, 200
#: New words that are encoded in one go, as one text; bytes of text in a block.
BATCH, BLOCK = 64, 1 << 21


class PartTokenizer:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        self.held = 0

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        """Words of letters only: each is one word to the tokenizer, so a joined text tells them apart."""
        for at in range(0, len(words), BATCH):
            some = words[at : at + BATCH]
            coded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            raw = np.array(coded.ids, "<u4").tobytes()
            ends = {w: i + 1 for i, w in enumerate(coded.word_ids)}
            start = 0
            for i in range(len(some)):
                yield raw[4 * start : 4 * ends[i]]
                start = ends[i]

    def _of_words(self, words: list[str]) -> list[bytes]:
        new = [w for w in words if w not in self.words and w not in self.before]
        coded = dict(zip(new, self._encode_words(new), strict=True))
        out = []
        for word in words:
            ids = self.words.get(word)
            if ids is None:
                ids = coded.get(word)
                if ids is None:
                    ids = self.before[word]
                out.append(ids)
                coded[word] = ids
            else:
                out.append(ids)
        self.words.update(coded)
        self.held += sum(ENTRY + len(w) + len(ids) for w, ids in coded.items())
        if self.held > REMEMBERED:
            self.words, self.before, self.held = {}, self.words, 0
        return out

    def _of_others(self, parts: list[str]) -> list[bytes]:
        coded = self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)
        return [np.array(c.ids, "<u4").tobytes() for c in coded]

    def _of_parts(self, parts: pa.Array) -> list[bytes]:
        found = pc.extract_regex(parts, SIMPLE)
        simple = pc.is_valid(found).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(parts)
        words = pc.utf8_lower(found.field("word").filter(pa.array(simple))).dictionary_encode()
        rests = found.field("rest").filter(pa.array(simple)).dictionary_encode()
        heads, tails = self._of_words(words.dictionary.to_pylist()), self._of_others(rests.dictionary.to_pylist())
        for i, w, r in zip(np.flatnonzero(simple).tolist(), words.indices.to_pylist(), rests.indices.to_pylist(), strict=True):
            out[i] = heads[w] + tails[r]
        others = np.flatnonzero(~simple)
        for i, ids in zip(others.tolist(), self._of_others(parts.take(pa.array(others)).to_pylist()), strict=True):
            out[i] = ids
        return out

    def blocks(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids of runs of texts, one after another, with the number of ids of each text."""
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        at = 0
        while at < len(texts):
            to = max(int(np.searchsorted(offsets, offsets[at] + BLOCK, "right")) - 1, at + 1)
            split = pc.ascii_split_whitespace(texts.slice(at, to - at))
            n_parts = pc.list_value_length(split).to_numpy(zero_copy_only=False)
            coded = split.flatten().dictionary_encode()
            ids = self._of_parts(coded.dictionary)
            sizes = np.array([len(x) // 4 for x in ids], np.int64)
            flat, firsts = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(sizes) - sizes
            codes = coded.indices.to_numpy()
            n = sizes[codes]
            ends = np.cumsum(n)
            take = np.repeat(firsts[codes] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)
            edges = np.append(0, ends)[np.append(0, np.cumsum(n_parts))]
            yield flat[take], np.diff(edges)
            at = to


@lru_cache(maxsize=2)
def part_tokenizer(path: str) -> PartTokenizer:
    return PartTokenizer(path)
