"""Phrase matching on canonical text.

A dictionary hit is a *substring* of the canonical text, not a word match.  The dictionaries
are fixed and short.  A message without any hit, the usual case, is dismissed by one pattern
that only starts matching at the rarest letter of a phrase; the others are asked for each
phrase in turn.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .dictionaries import TIERS, squeezed_phrases
from .entities import no_strings, word_list
from .text import (col, normalize, normalize_keep_accents, squeeze_spaces)

BRANCHES = 5
_COMMON_FIRST = " etaoinshrdlucmfwygpbvkxjqz2689"


def any_of(phrases) -> str:
    """Pattern that finds any of some literal phrases.

    Each phrase is anchored at its rarest letter: the rest of it follows, and a look-behind
    at its end checks the part before.  Most characters of a text fail the first test.
    """
    anchored: dict[str, list[str]] = {}
    for p in sorted(set(phrases)):
        at = max(range(len(p)), key=lambda i: _COMMON_FIRST.find(p[i]) % 99)
        anchored.setdefault(p[at], []).append(re.escape(p[at + 1:]) + f"(?<={re.escape(p)})")
    groups = [(re.escape(c), f"{re.escape(c)}(?:{'|'.join(rest)})") for c, rest in anchored.items()]

    def among(some: list[tuple[str, str]]) -> str:
        return f"(?=[{''.join(c for c, _ in some)}])(?:{'|'.join(g for _, g in some)})"

    # a few letters at a time, so that a letter is not compared with all of them
    few = [among(groups[i:i + BRANCHES]) for i in range(0, len(groups), BRANCHES)]
    return f"(?=[{''.join(c for c, _ in groups)}])(?:{'|'.join(few)})"


def has_any_keyword(norm) -> Column:
    return col(norm).rlike(any_of([p for tier in TIERS.values() for p in tier]))


def keyword_hits(norm, tier: str) -> Column:
    """Phrases of one tier found in canonical text, in alphabetical order."""
    n = col(norm)
    found = F.filter(word_list(sorted(TIERS[tier])), lambda phrase: n.contains(phrase))
    return F.when(n.rlike(any_of(TIERS[tier])), found).otherwise(no_strings())


def keyword_points(hits, weight) -> Column:
    """Weight for the first hit, one more for each further hit, at most two more."""
    n = F.size(col(hits))
    return F.when(n > 0, F.lit(weight) + F.least(n - 1, F.lit(2))).otherwise(0)


def noisy_keyword_points(strong_hits, medium_hits, squeezed) -> Column:
    """Phrases hidden by spaces between letters: 3 for a strong one, else 2 for a medium."""
    s = col(squeezed)
    found = {tier: s.rlike(any_of(squeezed_phrases(tier))) for tier in ("strong", "medium")}
    either = s.rlike(any_of(squeezed_phrases("strong") + squeezed_phrases("medium")))
    points = (F.when((F.size(col(strong_hits)) == 0) & found["strong"], 3)
              .when((F.size(col(medium_hits)) == 0) & found["medium"], 2).otherwise(0))
    return F.when(either, points).otherwise(0)


def phrase_forms(phrase) -> Column:
    """The four spellings a banned phrase is looked for in."""
    keep, plain = normalize_keep_accents(phrase), normalize(phrase)
    return F.struct(
        col(phrase).alias("phrase"), keep.alias("keep"), plain.alias("plain"),
        squeeze_spaces(keep).alias("keep_squeezed"),
        squeeze_spaces(plain).alias("plain_squeezed"))


def banned_phrase_hits(squeezed, forms) -> Column:
    """Banned phrases in accent-keeping canonical text, given without its spaces.

    A phrase counts when its accented or plain spelling is in the text, or either spelling
    without spaces in the text without spaces.  The former implies the latter, so only the
    latter is looked for.  An empty spelling would be found in every text; it is ignored.
    """
    s = col(squeezed)

    def inside(form: Column) -> Column:
        return (form != "") & s.contains(form)

    hits = F.filter(col(forms), lambda f: inside(f["keep_squeezed"]) | (
        (f["plain_squeezed"] != f["keep_squeezed"]) & inside(f["plain_squeezed"])))
    hits = F.transform(hits, lambda f: f["phrase"])
    return F.when((s != "") & (F.size(col(forms)) > 0), F.array_sort(hits)
                  ).otherwise(no_strings())
