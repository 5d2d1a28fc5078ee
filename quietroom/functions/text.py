"""Text canonicalisation as Column expressions.

Everything stays in the JVM.  NFKC / NFD come from the ICU library that Spark itself
ships, called through the SQL function ``reflect`` and only for rows holding a character
that normalisation could change, so plain Latin text never pays for it.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -------------------------------------------------------------
# Characters that are not drawn: soft hyphen, joiners, direction marks, selectors, BOM.
INVISIBLE_RANGES = (
    (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x180E, 0x180E), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
)
# Letters that look Latin, and what they look like.
LOOKALIKES = dict(zip("авсеѕһіјкмнортухԁɡν", "abceshijkmhoptyxdgv"))  # Cyrillic and kin
LOOKALIKES.update(zip("αβεικορτυχϲ", "abeikoptuxc"))  # Greek
LOOKALIKES.update(zip("０１２３４５６７８９", "0123456789"))  # full width
# Digits and signs used as letters.
LEET = dict(zip("013457@$", "oieastas"))
# Question phrases, matched on accent-free canonical text with a space put around it.
# They are told apart letter by letter, as every space of a text is tried.
QUESTION = (
    r" (?=[acdhmnpstvx])(?:"
    r"(?:c(?:o(?= ).{1,40}(?<= )(?:khong|ko|k|hong|hem)|o that|ho (?:minh |em )?hoi|o ai biet|o nen)"
    r"|t(?:hat khong|huc hu|he nao|ai sao)|phai khong|dung khong|h(?:ay khong|oi chut)|xin hoi"
    r"|a(?:i biet|i tung|d oi|dmin oi|nh chi oi)|moi nguoi oi|n(?:hu (?:the )?nao|en khong)|sao vay|vi sao) "
    r"|(?:vay a|vay ta|ha ban|nhi|the a) $)"
)
# Word characters and white space as the scoring rules understand them.
WORD = r"\p{L}\p{N}_"
SPACES = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())
SPACE = (r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
# ------------------------------------------------------------------------------

INVISIBLE = "".join(chr(c) for lo, hi in INVISIBLE_RANGES for c in range(lo, hi + 1))
ANY_INVISIBLE = "[" + "".join(rf"\x{{{lo:X}}}-\x{{{hi:X}}}" for lo, hi in INVISIBLE_RANGES) + "]"
_LOOKALIKE_CASES = "".join(chr(c) for c in range(0x80, 0x10000) if chr(c).lower() in LOOKALIKES)
# behind ranges, as each listed character beyond U+00FF is a test of its own
ANY_LOOKALIKE = rf"[\x{{251}}-\x{{52F}}\x{{A7AC}}\x{{FF10}}-\x{{FF19}}&&[{_LOOKALIKE_CASES}]]"
# letter, mark, letter, mark ... four times; begins at a mark, which most characters are not
SPLIT_LETTERS = rf"[.\-_*|](?<=[{WORD}].)(?:[{WORD}][.\-_*|]){{3}}[{WORD}]"
LATIN1 = r"[\x00-\xFF]++"
# Written out, as a class of listed characters is one look-up and a class of ranges several.
ALNUM = "abcdefghijklmnopqrstuvwxyz0123456789"
ICU_NORMALIZER = "com.ibm.icu.text.Normalizer"
STRINGS = "org.apache.commons.lang3.StringUtils"  # comes with Spark, too
NOT_ASCII = r"[^\x00-\x7F]"
# Anything but the characters up to U+00FF that NFKC leaves alone; these are listed, as ALNUM is.
NOT_PLAIN = "[^" + "".join(rf"\x{{{c:X}}}" for c in range(0x100) if unicodedata.is_normalized("NFKC", chr(c))) + "]"
MARKS = r"[\x{300}-\x{10FFFF}&&\p{Mn}]+"  # the range alone rules out most characters


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nfkc(c) -> Column:
    t = col(c)
    icu = F.reflect(F.lit(ICU_NORMALIZER), F.lit("compose"), t, F.lit(True))
    return F.when(t.rlike(NOT_ASCII), icu).otherwise(t)


def _translate(c: Column, table: dict[str, str], drop: str = "") -> Column:
    return F.translate(c, "".join(table) + drop, "".join(table.values()))


def replace_chars(c: Column, old: str, new: str) -> Column:
    """``translate`` by one plain loop over the characters; only for rows that are not null."""
    return F.reflect(F.lit(STRINGS), F.lit("replaceChars"), c, F.lit(old), F.lit(new))


def strip_diacritics(c) -> Column:
    """Drop accents (including the stroke of đ), keeping every base character."""
    t = F.translate(col(c), "đĐ", "dD")
    nfd = F.reflect(F.lit(ICU_NORMALIZER), F.lit("decompose"), t, F.lit(False))
    return F.when(t.rlike(NOT_ASCII), F.regexp_replace(nfd, r"\p{Mn}+", "")).otherwise(t)


def remove_invisible(c) -> Column:
    return F.translate(col(c), INVISIBLE, "")


def fold_homoglyphs(c) -> Column:
    return _translate(col(c), LOOKALIKES)


def fold_leet(c) -> Column:
    return _translate(col(c), LEET)


def collapse_repeats(c, among: str = r"[^\n]") -> Column:
    """Three or more of one character in a row become two; ``among`` may narrow them down to a class."""
    return F.regexp_replace(col(c), rf"({among})(?=\1\1)\1+", "$1$1")


def _spaced(c: Column, kept: str) -> Column:
    """Runs of characters outside the class ``[kept]`` become one space.  Single spaces, which most of the
    runs are, stay as they are."""
    return F.regexp_replace(c, rf"[^{kept}](?:(?<! )|(?=[^{kept}]))[^{kept}]*", " ")


@lru_cache(maxsize=1)
def _to_plain_letters() -> dict[str, str]:
    """Look-alikes, accents and leet in one table, for lower-case NFKC text.

    A look-alike wins over accent removal, and an accented look-alike is not folded, so
    only characters whose base is ASCII appear; all others end up as a space anyway.
    """
    table = {"đ": "d", **LOOKALIKES}
    for cp in range(0x80, 0x2C00):
        ch = chr(cp)
        if ch not in table:
            base = "".join(x for x in unicodedata.normalize("NFD", ch)
                           if unicodedata.category(x) != "Mn")
            if len(base) == 1 and (base in LEET or base.isascii() and base.isalnum()
                                   and base == base.lower()):
                table[ch] = base
    return {**LEET, **{k: LEET.get(v, v) for k, v in table.items()}}


@lru_cache(maxsize=1)
def _latin1_to_plain() -> tuple[str, str]:
    """What becomes of every character up to U+00FF that is not already plain, hidden ones last."""
    table = _to_plain_letters()
    kept = {chr(c): table.get(chr(c), " ") for c in range(0x100) if chr(c) not in INVISIBLE + ALNUM or chr(c) in table}
    hidden = "".join(x for x in INVISIBLE if ord(x) < 0x100)
    return "".join(kept) + hidden, "".join(kept.values())


def normalize(c) -> Column:
    """Accent-free canonical form: ``[a-z0-9]`` words separated by single spaces.

    One pass over the characters folds look-alikes, accents and leet and drops what is not
    drawn.  Every step uses the one before it once, so nothing is computed twice.  Texts up to U+00FF
    hold no mark and, after that pass, nothing but letters, digits and spaces: no pattern is needed.
    """
    t = col(c)
    plain = (F.octet_length(t) == F.char_length(t)) | ~t.rlike(NOT_PLAIN)
    narrow = F.reflect(F.lit(STRINGS), F.lit("normalizeSpace"), replace_chars(F.lower(t), *_latin1_to_plain()))
    wide = F.regexp_replace(_translate(F.lower(nfkc(t)), _to_plain_letters(), INVISIBLE), MARKS, "")
    words = F.when(plain, narrow).otherwise(F.trim(_spaced(wide, ALNUM)))
    return collapse_repeats(words, f"[{ALNUM}]")


def squeeze_spaces(c) -> Column:
    return F.replace(col(c), F.lit(" "), F.lit(""))


def squeeze(c) -> Column:
    return squeeze_spaces(normalize(c))


def normalize_keep_accents(c) -> Column:
    """Canonical form that keeps Vietnamese accents (``lừa đảo`` is not ``lựa đào``)."""
    table = {**LEET, **{k: LEET.get(v, v) for k, v in LOOKALIKES.items()}}
    t = _translate(F.lower(nfkc(c)), table, INVISIBLE)
    return F.btrim(collapse_repeats(_spaced(t, ALNUM + r"\x{E0}-\x{1EF9}")), F.lit(" \u1680"))


def squeeze_keep_accents(c) -> Column:
    return squeeze_spaces(normalize_keep_accents(c))


def beyond_latin1(c) -> Column:
    """The characters beyond U+00FF, which are few or none; classes of rare characters, slow to test,
    are looked for in these alone."""
    t = col(c)
    ascii_only = F.octet_length(t) == F.char_length(t)
    return F.when(ascii_only, "").otherwise(F.regexp_replace(t, LATIN1, ""))


def obfuscation_score(c, rare=None) -> Column:
    """3 for hidden characters, 3 for look-alike letters, 2 for s.p.l.i.t letters.

    ``rare`` may pass in ``beyond_latin1`` of the text.
    """
    t = col(c)
    r = beyond_latin1(t) if rare is None else col(rare)
    hidden = t.contains("\u00ad") | ((r != "") & r.rlike(ANY_INVISIBLE))
    latin = F.char_length(t) - F.char_length(F.regexp_replace(t, r"[A-Za-z\x{130}\x{212A}]+", ""))
    fakes = F.regexp_count(r, F.lit(ANY_LOOKALIKE))
    # letters are only counted in texts that hold look-alikes at all
    fake_enough = (r != "") & (fakes >= 2) & (fakes >= F.floor(latin / 10))
    split_letters = t.rlike(SPLIT_LETTERS)
    points = (F.when(hidden, 3).otherwise(0) + F.when(fake_enough, 3).otherwise(0)
              + F.when(split_letters, 2).otherwise(0))
    return F.coalesce(points, F.lit(0)).cast("int")


def looks_like_question(c, norm=None) -> Column:
    """``norm`` may pass in an already canonicalised column."""
    t = col(c)
    plain = F.concat(F.lit(" "), normalize(t) if norm is None else col(norm), F.lit(" "))
    return F.coalesce(t.contains("?") | plain.rlike(QUESTION), F.lit(False))
