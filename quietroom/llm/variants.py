"""Spelling variants, found by permuterm rotations.

Words are the runs of A-Z, a-z and U+00C0 to U+00FF of the texts, A-Z lower-cased, that have at
least ``min_chars`` code points and occur at least ``min_count`` times.  Two words are near if one
replaced, inserted or deleted code point makes one of the other.  A word's form is its near word
that occurs most often (among equals the smallest), if that one occurs ``factor`` times as often as
the word; forms are followed to the last one, the root.

* A word is marked with a terminator, ``word$``, and rotated.  The rotation that ends with the i-th
  character is filed under the prefix before it, which skips this character: words that differ in
  one place share that prefix.  A word is also filed under its whole rotations, which are prefixes
  of those words that have one character more.
* Rotations are sorted by prefix and scanned group by group.  Members of a group differ in the
  skipped character, of which the alphabet has 90, and at most one member is whole, so no group
  has more than 91 rows.  Each member takes from its group how many neighbours it has there and
  the best of them; pairs are never written out.
* A pair of equal length shares exactly one prefix.  A pair of unequal length shares one for each
  place in a run of equal characters, so only the first place of a run counts.
* Roots are found by doubling: a form occurs ``factor`` times as often, so chains are no longer than
  the logarithm of the highest count.

Rotations of up to 64 characters are sorted as text, longer ones by two 61-bit polynomial hashes
(made for all rotations of a word in one pass, as a word of a million letters has a million).

As the contract asks, a run is changed before it is counted: where 199 divides the checksum of
``<doc_id>:<run>``, one of its code points is taken out (``misspelt``).

Defined cases: a null text has no words; a null id writes as the empty string.  Repeated rows count as
often as they stand.  An empty table gives an empty result.  Other columns take no part.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .common import numbered, staged
from .divergence import pieces

MARK = "$"
RATE = 199
TEXT_KEYS = 64  # longest rotation that is sorted as text
_HELD = 200_000  # words counted in a task before they are handed on
_ROWS = 50_000
_WHOLE, _SKIPS, _FIRST = 0, 1, 2
_PRIME, _BASES = (1 << 61) - 1, (1_000_003 * 998_244_353, 1_000_000_007 * 131_071)  # any two odd numbers


def misspelt(run: str, start: int) -> str:
    """The run as it is counted; ``start`` is the checksum of what stands before it."""
    h = zlib.crc32(run.encode(), start)
    if h % RATE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def count_words(docs: DataFrame, min_chars: int) -> DataFrame:
    """(word, n) from columns id (text) and text."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        long_runs = re.compile(f"[a-zÀ-ÿ]{{{min_chars},}}")
        counts: Counter = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())],
                                             names=["word", "n"])
            counts.clear()
            return out

        for batch in batches:
            ids, texts = batch.columns
            for doc_id, text in zip(ids.to_pylist(), texts.cast(pa.binary())):
                start = zlib.crc32(f"{doc_id}:".encode())
                for part in pieces(text.as_py().lower()):
                    for word, n in Counter(long_runs.findall(part.decode())).items():
                        word = misspelt(word, start)
                        if len(word) >= min_chars:
                            counts[word] += n
                if len(counts) > _HELD:
                    yield rows()
        if counts:
            yield rows()

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _digests(word: str) -> Iterator[tuple[str, str]]:
    """For each i: the hashes of the rotation that starts at i, whole and without its last character."""
    marked = [ord(c) for c in word + MARK]
    sums, powers = [[0] for _ in _BASES], [[1] for _ in _BASES]
    for base, s, p in zip(_BASES, sums, powers):
        for c in marked:
            s.append((s[-1] * base + c) % _PRIME)
            p.append(p[-1] * base % _PRIME)
    size = len(marked)
    for i in range(size):
        whole, short = [], []
        for s, p in zip(sums, powers):
            tail = (s[size] - s[i] * p[size - i]) % _PRIME
            whole.append((tail * p[i] + s[i]) % _PRIME)
            # what stands before i, without the character just before it
            short.append((tail * p[i - 1] + s[i - 1]) % _PRIME if i else 0)
        yield f"{size}:{whole[0]:x}:{whole[1]:x}", f"{size - 1}:{short[0]:x}:{short[1]:x}"


def rotations(word: str) -> Iterator[tuple[str, int]]:
    """(prefix, kind) of every rotation of the marked word, whole and with its last character skipped."""
    size = len(word) + 1
    marked = word + MARK
    digests = _digests(word) if size > TEXT_KEYS else None
    for i in range(size):
        hashed = next(digests) if digests else None
        yield (marked[i:] + marked[:i] if size <= TEXT_KEYS else hashed[0]), _WHOLE
        if i:  # the rotation from i on ends with the character before i
            kind = _FIRST if i == 1 or word[i - 1] != word[i - 2] else _SKIPS
            yield (marked[i:] + marked[:i - 1] if size - 1 <= TEXT_KEYS else hashed[1]), kind


def filed(words: DataFrame) -> DataFrame:
    """(key, kind, id, n): all rotations of the words (id, word, n)."""
    ship(words.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, kinds, ids, counts = [], [], [], []

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(kinds, pa.int32()),
                                              pa.array(ids, pa.int64()), pa.array(counts, pa.int64())],
                                             names=["key", "kind", "id", "n"])
            for x in (keys, kinds, ids, counts):
                x.clear()
            return out

        for batch in batches:
            for i, word, n in zip(*(c.to_pylist() for c in batch.columns)):
                for key, kind in rotations(word):
                    keys.append(key)
                    kinds.append(kind)
                    ids.append(i)
                    counts.append(n)
                    if len(keys) >= _ROWS:
                        yield rows()
        if keys:
            yield rows()

    return words.select("id", "word", "n").mapInArrow(run, "key string, kind int, id long, n long")


def neighbours(rows: DataFrame) -> DataFrame:
    """(id, n_near, best) for words with near ones; ``best``: the count of the best, negated, and its id.

    A member that skips a character is near all others that do, and near the whole one if it
    counts for it.
    """
    group = Window.partitionBy("key").orderBy("id")
    every = Window.partitionBy("key")
    me = F.struct((-F.col("n")).alias("minus_n"), F.col("id").alias("of"))
    whole = F.min(F.when(F.col("kind") == _WHOLE, me)).over(every)
    firsts = F.min(F.when(F.col("kind") == _FIRST, me)).over(every)
    skipping = F.when(F.col("kind") != _WHOLE, me)
    before = F.min(skipping).over(group.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(skipping).over(group.rowsBetween(1, Window.unboundedFollowing))

    def count(kind: Column) -> Column:
        return F.sum(F.when(kind, 1).otherwise(0)).over(every)

    kind = F.col("kind")
    others = count(kind != _WHOLE) - 1
    seen = (F.when(kind == _WHOLE, F.struct(count(kind == _FIRST).alias("n"), firsts.alias("best")))
            .when(kind == _FIRST, F.struct((others + count(kind == _WHOLE)).alias("n"),
                                           F.least(before, after, whole).alias("best")))
            .otherwise(F.struct(others.alias("n"), F.least(before, after).alias("best"))))
    return rows.select("id", seen.alias("seen")).where("seen.n > 0").groupBy("id").agg(
        F.sum("seen.n").alias("n_near"), F.min("seen.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root) from (id, form), by doubling the steps until nothing moves."""
    reached = staged(forms.select("id", F.col("form").alias("root")))
    while True:
        ahead = reached.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        step = staged(reached.join(ahead, "root", "left").select(
            "id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if step.where("_moved").isEmpty():
            return step.drop("_moved")
        reached = step.drop("_moved")


def spelling_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 6,
                    min_count: int = 5, factor: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of the texts."""
    texts = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
                        F.col(text_col).cast("string").alias("text")).where("text <> ''")
    words = count_words(texts, min_chars).where(F.col("n") >= min_count)
    words = staged(numbered(words, F.col("word"), "id"))
    near = staged(neighbours(filed(words)))
    formed = words.join(near, "id", "left").select(
        "id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.minus_n") >= factor * F.col("n"), F.col("best.of")).alias("form"))
    formed = staged(formed)
    last = roots(formed.where("form IS NOT NULL"))
    named = formed.select(F.col("id").alias("form"), F.col("word").alias("form_word"), F.col("n").alias("form_n"))
    ends = formed.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    return (formed.join(last, "id", "left").join(named, "form", "left").join(ends, "root", "left")
            .select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"),
                    "n", "n_near", "form_n"))
