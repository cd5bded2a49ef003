"""A minimised acceptor of a sorted word list, composed with a one-edit transducer and itself.

States are interned by what they accept, from the last letters back, so words with equal endings share them;
chains without a branch are one arc with a longer label.  The composition runs the acceptor twice in step: up
to the edit both sides are in one state, which must be a branch; there the transducer replaces a letter (two
arcs) or inserts one (an arc against the state itself), and from then on both sides must read the same letters
to the end.  What a state yields does not depend on how it was reached and is worked out once.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

Place = tuple[str, int]  # letters still to read of an arc's label, and the state after them


class Acceptor:
    """The minimal acceptor of distinct words in sorted order."""

    def __init__(self, words: list[str]) -> None:
        self.final: list[bool] = []
        self.arcs: list[dict[str, Place]] = []
        self._known: dict[tuple, int] = {}
        self._pairs: dict[int, list[tuple[str, str]]] = {}
        open_nodes: list[tuple[int, list[bool], list[tuple[str, int]]]] = [(0, [False], [])]
        for word, after in zip(words, [*words[1:], ""][: len(words)], strict=True):
            shared = len(commonprefix((word, after)))
            if open_nodes[-1][0] < len(word):
                open_nodes.append((len(word), [True], []))
            else:
                open_nodes[-1][1][0] = True
            while open_nodes[-1][0] > shared:
                depth, final, arcs = open_nodes.pop()
                if open_nodes[-1][0] < shared:
                    open_nodes.append((shared, [False], []))
                open_nodes[-1][2].append((word[open_nodes[-1][0] : depth], self._state(final[0], arcs)))
        self.root = self._state(open_nodes[0][1][0], open_nodes[0][2])

    def _state(self, final: bool, arcs: list[tuple[str, int]]) -> int:
        key = (final, tuple(arcs))
        found = self._known.get(key)
        if found is None:
            found = self._known[key] = len(self.final)
            self.final.append(final)
            self.arcs.append({label[0]: (label[1:], state) for label, state in arcs})
        return found

    def _both(self, one: Place, two: Place) -> list[str]:
        """Words that both places accept."""
        found, work = [], [("", *one, *two)]
        while work:
            read, rest, state, other_rest, other = work.pop()
            if rest and other_rest:
                n = min(len(rest), len(other_rest))
                if rest[:n] == other_rest[:n]:
                    work.append((read + rest[:n], rest[n:], state, other_rest[n:], other))
            elif rest or other_rest:
                label, at = (rest, other) if rest else (other_rest, state)
                arc = self.arcs[at].get(label[0])
                if arc:
                    work.append((read + label[0], label[1:], state if rest else other, *arc))
            else:
                if self.final[state] and self.final[other]:
                    found.append(read)
                theirs = self.arcs[other]
                work += [(read + a, *arc, *theirs[a]) for a, arc in self.arcs[state].items() if a in theirs]
        return found

    def _edits(self, state: int) -> list[tuple[str, str]]:
        """Pairs of endings accepted from a state that first differ here, by one edit."""
        found = self._pairs.get(state)
        if found is None:
            found, arcs = [], list(self.arcs[state].items())
            for i, (a, one) in enumerate(arcs):
                for b, two in arcs[i + 1 :]:
                    found += [(a + v, b + v) for v in self._both(one, two)]
                    # An inserted a before what starts with b, and the other way round.
                    found += [(a + v, v) for v in self._both(one, (b + two[0], two[1]))]
                    found += [(b + v, v) for v in self._both(two, (a + one[0], one[1]))]
                if self.final[state] and not one[0] and self.final[one[1]]:
                    found.append((a, ""))
            self._pairs[state] = found
        return found

    def near_pairs(self) -> Iterator[tuple[str, str]]:
        """Every pair of accepted words that one inserted, deleted or replaced code point parts, once."""
        work = [("", self.root)]
        while work:
            read, state = work.pop()
            for x, y in self._edits(state):
                yield read + x, read + y
            work += [(read + a + rest, after) for a, (rest, after) in self.arcs[state].items() if self.arcs[after]]
