"""Patterns of query phrases and exclusion terms, built on the driver and applied as literals."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_BETWEEN = r"[\s\-]+"
_META = re.compile(r"([\\^$.|?*+()\[\]{}\-])")


def quoted(text: str) -> str:
    return _META.sub(r"\\\1", text)


def _alone(body: str) -> str:
    """The body with no ASCII letter or digit on either side, in any case, by Unicode classes."""
    return rf"(?iU)(?<![a-z0-9]){body}(?![a-z0-9])"


def phrase_pattern(query: str) -> str:
    """Words side by side, parted by white space or hyphens.

    The last word may end in s or not, whichever the query has. A word of one or two letters that isn't first may carry
    digits instead, with or without a hyphen.
    """
    words = query.lower().split()
    bodies = []
    for place, word in enumerate(words):
        if place and len(word) <= 2:
            bodies.append(quoted(word) + r"(?:-?\d+)?")
        elif place + 1 == len(words):
            bodies.append(quoted(word.removesuffix("s")) + "s?")
        else:
            bodies.append(quoted(word))
    return _alone(_BETWEEN.join(bodies))


def term_pattern(term: str) -> str:
    """A term's words, literally."""
    return _alone(_BETWEEN.join(map(quoted, term.lower().split())))


def any_order(text: Column, query: str) -> Column:
    """Whether every word of the query is in the text as a whole word."""
    found = F.lit(True)
    for word in query.lower().split():
        found = found & text.rlike(rf"(?iU)\b{quoted(word)}\b")
    return found
