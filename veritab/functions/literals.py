"""What a text must hold for a regex to match in it: alternatives of literal strings."""

from __future__ import annotations

import itertools
from re import _constants as C
from re import _parser

#: Strings followed at once, and the least length of a literal that is asked for.
FOLLOWED, LEAST = 64, 3

#: Alternatives, each a set of literals that all must be there; an empty one asks for nothing.
Needs = frozenset
NOTHING: Needs = frozenset([frozenset()])


def needed(pattern: str) -> Needs:
    """Alternatives of literals, in lower case: every text that pattern matches, in whichever case, holds all literals of one of them."""
    return _closed(*_sequence(_parser.parse(pattern)))


def either(*needs: Needs) -> Needs:
    return _least(itertools.chain.from_iterable(needs))


def both(a: Needs, b: Needs) -> Needs:
    if len(a) * len(b) > FOLLOWED:
        return min(a, b, key=lambda n: (frozenset() in n, len(n)))
    return _least(x | y for x in a for y in b)


def _least(alternatives) -> Needs:
    own = {frozenset(s for s in a if not any(s != t and s in t for t in a)) for a in alternatives}
    return frozenset(a for a in own if not any(b != a and all(any(s in t for t in a) for s in b) for b in own))


def _closed(strings: set[str] | None, needs: Needs) -> Needs:
    return needs if strings is None else both(needs, _least(frozenset([s] if len(s) >= LEAST else []) for s in strings))


def _sequence(parts) -> tuple[set[str] | None, Needs]:
    """The strings that parts stand for if they are few (else None), and what is needed besides."""
    strings, needs, whole = {""}, NOTHING, True
    for op, value in parts:
        own, also = _part(op, value)
        if own is not None and len(own) * len(strings) <= FOLLOWED:
            strings = {a + b for a in strings for b in own}
        else:
            needs = both(_closed(strings, needs), also if own is None else NOTHING)
            strings, whole = (own or {""}), False
    return (strings, needs) if whole else (None, _closed(strings, needs))


def _part(op, value) -> tuple[set[str] | None, Needs]:
    if op is C.LITERAL:
        c = chr(value)
        return ({c.lower()} if c.isascii() or not c.isalpha() else None), NOTHING
    if op is C.IN and len(value) <= 4 and all(kind is C.LITERAL and chr(c).isascii() for kind, c in value):
        return {chr(c).lower() for _, c in value}, NOTHING
    if op is C.SUBPATTERN:
        return _sequence(value[3])
    if op is C.BRANCH:
        parts = [_sequence(p) for p in value[1]]
        if all(s is not None for s, _ in parts) and len(out := set().union(*[s for s, _ in parts])) <= FOLLOWED:
            return out, NOTHING
        return None, either(*[_closed(*p) for p in parts])
    if op in (C.MAX_REPEAT, C.MIN_REPEAT):
        least, most, part = value
        strings, needs = _sequence(part)
        if most == 1 and strings is not None:
            return strings | ({""} if least == 0 else set()), NOTHING
        return None, (_closed(strings, needs) if least else NOTHING)
    if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
        return {""}, NOTHING
    return None, NOTHING
