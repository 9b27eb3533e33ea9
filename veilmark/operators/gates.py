"""What a text must hold for a pattern to match at all, told from the pattern's parts: a cheap test before each pattern.

A pattern needs one character out of each of some sets (a digit, an ``@``, one of ``:=``). Only sets of digits and symbols count, as letters
have cases and look-alikes. One scan takes such characters out of a text, and all patterns ask that short string.
"""

from __future__ import annotations

import string
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

try:  # the parser that Python's own expressions are compiled by
    from re import _parser as parser
except ImportError:  # without it no pattern has needs
    parser = None

#: Characters that tell something; full stops, commas, hyphens and white space are in most texts.
TELLING = string.digits + "@:=/_№+#~"


def _class(items) -> frozenset[str] | None:
    out: set[str] = set()
    for kind, value in items:
        name = str(kind)
        if name == "LITERAL":
            out.add(chr(value))
        elif name == "RANGE" and value[1] - value[0] < 64:
            out.update(map(chr, range(value[0], value[1] + 1)))
        elif name == "CATEGORY" and str(value) == "CATEGORY_DIGIT":
            out.update(string.digits)
        else:
            return None
    return frozenset(out)


def _sequence(parts) -> set[frozenset[str]]:
    out: set[frozenset[str]] = set()
    for kind, value in parts:
        name = str(kind)
        if name == "LITERAL":
            out.add(frozenset(chr(value)))
        elif name == "IN" and (own := _class(value)):
            out.add(own)
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            out |= _sequence(value[2])
        elif name == "SUBPATTERN":
            out |= _sequence(value[3])
        elif name == "ATOMIC_GROUP":
            out |= _sequence(value)
        elif name == "BRANCH":
            ways = [_telling(_sequence(way)) for way in value[1]]
            if all(ways):  # one need of each way, so that any way shows in the union
                out.add(frozenset().union(*(min(way, key=lambda x: (len(x), sorted(x))) for way in ways)))
    return out


def _telling(needs: set[frozenset[str]]) -> set[frozenset[str]]:
    return {x for x in needs if x and x <= set(TELLING)}


@lru_cache(maxsize=4096)
def needs(regex: str) -> frozenset[frozenset[str]]:
    """Sets of characters of which a match, and so its text, has one each; empty if nothing is known."""
    if parser is None:
        return frozenset()
    try:
        return frozenset(_telling(_sequence(parser.parse(regex))))
    except Exception:  # an expression of Java's own
        return frozenset()


def telling(text: Column) -> Column:
    """The telling characters of a text, in order."""
    return F.regexp_replace(text, "[^" + TELLING + "]+", "")


def may_match(told: Column, regex: str) -> Column | None:
    """Whether a text with these telling characters may match; null if nothing is known."""
    tests = [F.contains(told, F.lit(next(iter(x)))) if len(x) == 1 else told.rlike("[" + "".join(sorted(x)) + "]") for x in sorted(needs(regex), key=lambda x: (len(x), sorted(x)))]
    out = None
    for test in tests:
        out = test if out is None else out & test
    return out
