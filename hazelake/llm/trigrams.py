"""Trigram queries derived from regular expressions.

A query is a list of clauses that must all hold; a clause is a list of strings of which one must occur,
which it does only where all its trigrams occur. A rule without a clause has no mandatory trigram.
"""

from __future__ import annotations

import re._constants as C
import re._parser as parser
from itertools import product

MOST_STRINGS = 32
MOST_OF_CLASS = 4


def _joined(left: set[str], right: set[str]) -> set[str]:
    return {a + b for a, b in product(left, right)}


def _of_class(items) -> set[str] | None:
    found: set[str] = set()
    for op, value in items:
        if op is C.LITERAL:
            found.add(chr(value).lower())
        elif op is C.RANGE and value[1] - value[0] < MOST_OF_CLASS:
            found |= {chr(v).lower() for v in range(value[0], value[1] + 1)}
        else:
            return None
    return found if len(found) <= MOST_OF_CLASS else None


def _walk(tokens, clauses: list[set[str]]) -> set[str] | None:
    """The strings that the tokens match, if they are few; else None, with clauses added for parts."""
    current, exact = {""}, True

    def close():
        nonlocal current, exact
        if min(map(len, current)) >= 3:
            clauses.append(current)
        current, exact = {""}, False

    for op, value in tokens:
        strings: set[str] | None = None
        if op is C.LITERAL:
            strings = {chr(value).lower()}
        elif op is C.IN:
            strings = _of_class(value)
        elif op is C.AT:
            strings = {""}
        elif op is C.SUBPATTERN:
            strings = _walk(value[-1], clauses)
        elif op is C.BRANCH:
            branches = [_walk(b, []) for b in value[1]]
            strings = None if None in branches else set().union(*branches)
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT):
            least, most, inner = value
            own: list[set[str]] = []
            once = _walk(inner, own)
            if once is not None and (least, most) == (0, 1):
                strings = {""} | once
            elif once is not None and least == most and len(once) == 1:
                strings = {next(iter(once)) * least}
            elif least >= 1:
                clauses += own
        if strings is None:
            close()
        elif len(grown := _joined(current, strings)) > MOST_STRINGS:
            close()
            current = strings
        else:
            current = grown
    if exact:
        return current
    close()
    return None


def clauses_of(pattern: str) -> list[list[str]]:
    """Clauses of lower-case strings; a string that contains another of its clause is left out."""
    found: list[set[str]] = []
    whole = _walk(parser.parse(pattern), found)
    if whole is not None and min(map(len, whole)) >= 3:
        found.append(whole)
    return [sorted(s for s in c if not any(o != s and o in s for o in c)) for c in found]


def trigrams(string: str) -> list[str]:
    return sorted({string[i:i + 3] for i in range(len(string) - 2)})
