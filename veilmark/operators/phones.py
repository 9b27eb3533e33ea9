"""Numbering plans as tries: country codes and national prefixes with the lengths that numbers below them have.

A number is international (``+`` and country code) or national: behind the region's trunk digit, or, where regions write none, in the
groups they write. The tries of the wanted regions become one expression over a number's digits, so numbers are judged on the JVM. The plans are reduced
to leading digits and lengths of the seven regions; which area codes are given out is not in them.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache


@dataclass(frozen=True)
class Plan:
    """``prefixes``: leading digits of national numbers with how many digits there are in all; a set in brackets is any of its digits."""

    code: str
    trunk: str
    prefixes: dict[str, tuple[int, ...]]
    written: str = ""  # a whole national number where no trunk digit tells it


# Country codes, trunk digits, leading digits and lengths of the regions' national numbers.
PLANS = {
    "RU": Plan("7", "8", {"[3489]": (10,)}),
    "KZ": Plan("7", "8", {"[67]": (10,)}),
    "UA": Plan("380", "0", {"[3-9]": (9,)}),
    "US": Plan("1", "", {"[2-9][0-8][0-9][2-9]": (10,)}, r"(?:1[ .-])?(?:\([2-9][0-8]\d\) ?|[2-9][0-8]\d[ .-])[2-9]\d{2}[ .-]\d{4}"),
    "GB": Plan("44", "0", {"1": (9, 10), "2": (10,), "3": (10,), "5[56]": (10,), "7": (10,), "8": (9, 10), "9": (10,)}),
    "DE": Plan("49", "0", {"15": (11,), "1[67]": (10, 11), "[2-9]": (7, 8, 9, 10, 11)}),
    "PL": Plan("48", "", {"[1-9]": (9,)}, r"(?:4[5]|5[0137]|6[069]|7[2389]|88)\d[ -]\d{3}[ -]\d{3}"),
}

INTERNATIONAL = r"(?<![\d\p{L}])\+\d(?:[ ().-]*\d){8,14}(?![\d\p{L}])"
#: A national number: digits in groups, not behind a plus, not part of a longer number or a word, and no date.
NATIONAL = r"(?<![\d\p{L}+./(-])(?<!\+\d[ (-])(?<!\+\d\d[ -])(?<!\+\d\d\d[ -])(?!\d{1,2}[ /-]\d{1,2}[ /-]\d{2,4}(?!\d))\(?\d(?:[ ()./-]{0,2}\d){7,12}(?![\d\p{L}]|[./-]\d)"


def _digits(prefix: str) -> list[str]:
    """The single digits or sets that a prefix is made of."""
    out, at = [], 0
    while at < len(prefix):
        end = prefix.index("]", at) + 1 if prefix[at] == "[" else at + 1
        out.append(prefix[at:end])
        at = end
    return out


def trie(regions: list[str], national: bool) -> dict:
    """Nested by digit or set; the lengths that remain are below ``""``."""
    root: dict = {}
    for region in regions:
        plan = PLANS.get(region)
        if plan is None or national and not plan.trunk:
            continue
        for prefix, lengths in plan.prefixes.items():
            steps = [*(plan.trunk if national else plan.code), *_digits(prefix)]
            node = root
            for s in steps:
                node = node.setdefault(s, {})
            node.setdefault("", set()).update(n - len(_digits(prefix)) for n in lengths)
    return root


def _expression(node: dict) -> str:
    ways = [rf"\d{{{n}}}" for n in sorted(node.get("", ()))]
    ways += [step + _expression(below) for step, below in node.items() if step]
    return ways[0] if len(ways) == 1 else "(?:" + "|".join(ways) + ")"


@lru_cache(maxsize=256)
def valid(regions: tuple[str, ...], national: bool) -> str:
    """An expression for the digits of a number; one that matches nothing if no region has such numbers."""
    root = trie(list(regions), national)
    return rf"^{_expression(root)}\z" if root else r"^(?!)"


@lru_cache(maxsize=256)
def written(regions: tuple[str, ...]) -> str:
    """An expression for national numbers of the regions that write no trunk digit."""
    forms = [PLANS[r].written for r in regions if r in PLANS and PLANS[r].written]
    return rf"^(?:{'|'.join(forms)})\z" if forms else r"^(?!)"
