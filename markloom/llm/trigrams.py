"""Boolean trigram queries of regular expressions.

``query(pattern)`` returns a list of clauses; a text that matches holds, for every clause, all trigrams of
at least one of the clause's alternatives (sets of trigrams, in lower case).  An empty list means that
nothing is mandatory: such a rule must scan every text.
"""

from __future__ import annotations

import re._constants as kinds
import re._parser as parser

#: Alternatives a run of literals may have before it is closed, and characters a class may stand for.
MOST_ALTERNATIVES, MOST_CHARS = 32, 8


def _chars(kind, value) -> list[str] | None:
    """The few characters an item stands for, in lower case; None if they are many."""
    if kind is kinds.LITERAL:
        return [chr(value).lower()]
    if kind is kinds.IN:
        found: set[str] = set()
        for k, v in value:
            if k is kinds.LITERAL:
                found.add(chr(v).lower())
            elif k is kinds.RANGE and v[1] - v[0] < MOST_CHARS:
                found |= {chr(c).lower() for c in range(v[0], v[1] + 1)}
            else:
                return None
        return sorted(found) if len(found) <= MOST_CHARS else None
    return None


def _exact(items) -> list[str] | None:
    """All strings a sequence of items matches, if they are few."""
    found = [""]
    for kind, value in items:
        some: list[str] | None = _chars(kind, value)
        if kind is kinds.SUBPATTERN:
            some = _exact(value[3])
        elif kind is kinds.BRANCH:
            parts = [_exact(p) for p in value[1]]
            some = None if None in parts else [s for p in parts for s in p]
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[1] <= 1:
            once = _exact(value[2])
            some = None if once is None else (["", *once] if value[0] == 0 else once)
        if some is None or len(found) * len(some) > MOST_ALTERNATIVES:
            return None
        found = [a + b for a in found for b in some]
    return found


def _grams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _clauses(items) -> list[list[frozenset[str]]]:
    clauses: list[list[frozenset[str]]] = []
    run = [""]

    def close() -> None:
        nonlocal run
        if min(map(len, run)) >= 3:
            sets = {_grams(s) for s in run}
            clauses.append([a for a in sets if not any(b < a for b in sets)])
        run = [""]

    for item in items:
        kind, value = item
        some = _exact([item])
        if some is not None and len(run) * len(some) <= MOST_ALTERNATIVES:
            run = [a + b for a in run for b in some]
            continue
        close()
        if some is not None:
            run = some
        elif kind is kinds.SUBPATTERN:
            clauses += _clauses(value[3])
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT) and value[0] >= 1:
            clauses += _clauses(value[2])
    close()
    return clauses


def query(pattern: str) -> list[list[frozenset[str]]]:
    return _clauses(list(parser.parse(pattern)))
