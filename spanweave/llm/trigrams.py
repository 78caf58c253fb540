"""Boolean trigram queries from regular expressions.

A query is a set of alternatives, each a set of trigrams that all occur in the
lower-cased text of any match.  ``None`` says that no trigram is mandatory.
Where a pattern stands for more strings than ``MOST``, the query gets weaker,
so more documents are verified; no result depends on it.
"""

from __future__ import annotations

import re
from re import _constants as op
from re import _parser as parser

#: Sets of literal strings larger than this are no longer followed.
MOST = 64


def _grams(words: set[str]) -> set[frozenset[str]] | None:
    if any(len(w) < 3 for w in words):
        return None
    return {frozenset(w[i : i + 3] for i in range(len(w) - 2)) for w in words}


def _both(a: set | None, b: set | None) -> set | None:
    if a is None or b is None:
        return b if a is None else a
    both = {x | y for x in a for y in b}
    return both if len(both) <= MOST else a


def _either(parts: list[set | None]) -> set | None:
    return None if any(p is None for p in parts) else set().union(*parts)


def _charset(items) -> set[str] | None:
    found: set[str] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            found.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 8:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= 8 else None


def _node(kind, value) -> tuple[set[str] | None, set | None]:
    """The exact strings of a node, if few, and else its query."""
    if kind is op.LITERAL:
        return {chr(value).lower()}, None
    if kind is op.IN:
        return _charset(value), None
    if kind is op.SUBPATTERN:
        return _sequence(value[3])
    if kind is op.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(p[0] is not None for p in parts):
            words = set().union(*(p[0] for p in parts))
            return (words, None) if len(words) <= MOST else (None, _grams(words))
        return None, _either([p[1] if p[0] is None else _grams(p[0]) for p in parts])
    if kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
        least, most, inner = value
        words, query = _sequence(inner)
        if words is not None and (least, most) == (0, 1):
            return words | {""}, None
        if words is not None and least == most and len(words) ** least <= MOST:
            out = {""}
            for _ in range(least):
                out = {a + b for a in out for b in words}
            return out, None
        return None, None if least == 0 else (query if words is None else _grams(words))
    if kind is op.AT:
        return {""}, None
    return None, None


def _sequence(nodes) -> tuple[set[str] | None, set | None]:
    run, query, exact = {""}, None, True
    for kind, value in nodes:
        words, inner = _node(kind, value)
        if words is not None and len(run) * len(words) <= MOST:
            run = {a + b for a in run for b in words}
            continue
        exact = False
        query = _both(_both(query, _grams(run)), inner)
        run = {""} if words is None else words
    return (run, None) if exact else (None, _both(query, _grams(run)))


def trigram_query(pattern: str) -> set[frozenset[str]] | None:
    words, query = _sequence(parser.parse(pattern))
    return _grams(words) if words is not None else query


def any_of(grams: set[str]) -> str:
    """A regex whose first group is the trigram at each place that has one of ``grams``; overlapping ones are found too."""
    heads: dict[str, dict[str, list[str]]] = {}
    for g in sorted(grams):
        heads.setdefault(g[0], {}).setdefault(g[1], []).append(g[2])
    one = lambda chars: f"[{''.join(map(re.escape, chars))}]"
    tails = {a: "|".join(re.escape(b) + one(c) for b, c in more.items()) for a, more in heads.items()}
    return f"(?={one(tails)})(?=({'|'.join(f'{re.escape(a)}(?:{t})' for a, t in tails.items())}))"
