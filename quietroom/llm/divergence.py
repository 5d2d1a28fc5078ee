"""Source divergence audit: how differently the sources of a language use its words.

Terms are runs of letters (A-Z, a-z and every character beyond ASCII), with A-Z lower-cased.  A
language keeps the V terms that stand in at least ``min_docs`` of its documents.  Every (language,
source) group, and the language as a whole, gives each kept term the price
``1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))``, with N the sum of its counts.

1. Each task counts terms as it reads, with a bounded table, so that a hot source arrives as few
   rows; counts are summed, terms kept, and numbered in order over all languages.
2. A group's counts become sorted (term id, count) arrays, one per block of ``BLOCK`` term ids, so
   that no row grows with the vocabulary.
3. Each unordered pair of groups of a language is a task of its own per block: the arrays of both
   are co-grouped, a galloping intersection finds the terms both have and prices them, then
   those that one side has alone.  Terms that neither has need no look: they all differ by the
   same.  Blocks are summed up, and each pair is told from both sides.
4. Terms that a group prices above its language are ranked in a window over counts.

All arithmetic is on integers.  The products would leave 64 bits, so that a division is done in two
steps (``price``); it is exact for counts up to 10^14.

Defined cases: a null text, language or source counts as the empty string, and an empty language
or source is one like any other.  A document is a row; repeated rows count as often as they stand.
A group without kept terms takes part with counts of 0.  Where a language keeps no term, all
pairs have value 0 and rank by name.  A language with one source has no pairs.  An empty table
gives an empty result.  Other columns take no part.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .common import numbered, staged

SCALE, SMOOTH = 1_000_000_000, 5
BLOCK = 16_384
_HELD = 200_000  # terms counted in a task before they are handed on
_PIECE = 1 << 20  # bytes of a text that are split at a time
#: In UTF-8 the bytes of characters beyond ASCII are those from 128 on.
_TERM, _GAP = re.compile(rb"[a-z\x80-\xff]+"), re.compile(rb"[^a-z\x80-\xff]")


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text in parts that are cut between terms."""
    at = 0
    while len(text) - at > _PIECE:
        gap = _GAP.search(text, at + _PIECE)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end
    yield text[at:]


def count_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, n_docs) from columns lang, source, text; one row per group has a
    null term and says that the group is there."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses: dict[tuple, Counter] = {}
        found: dict[tuple, Counter] = {}
        seen: set[tuple] = set()
        held = 0

        def rows() -> Iterator[pa.RecordBatch]:
            for key, n in uses.items():
                terms = list(n)
                new = key not in seen
                seen.add(key)
                yield pa.RecordBatch.from_arrays([
                    pa.array([key[0]] * (len(terms) + new), pa.string()), pa.array([key[1]] * (len(terms) + new), pa.string()),
                    pa.array([None] * new + terms, pa.binary()).cast(pa.string()),
                    pa.array([0] * new + list(n.values()), pa.int64()),
                    pa.array([0] * new + [found[key][t] for t in terms], pa.int64())],
                    names=["lang", "source", "term", "n", "n_docs"])
            uses.clear()
            found.clear()

        for batch in batches:
            lang, source, texts = batch.columns
            for key, text in zip(zip(lang.to_pylist(), source.to_pylist()), texts.cast(pa.binary())):
                if key not in uses:
                    uses[key], found[key] = Counter(), Counter()
                mine, before = uses[key], len(uses[key])
                own: set[bytes] = set()
                for part in pieces(text.as_py().lower()):
                    terms = _TERM.findall(part)
                    mine.update(terms)
                    own.update(terms)
                found[key].update(own)
                held += len(mine) - before
                if held > _HELD:
                    yield from rows()
                    held = 0
        yield from rows()

    return docs.mapInArrow(run, "lang string, source string, term string, n long, n_docs long")


def price(count: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exact."""
    whole, count = total + SMOOTH * terms, np.asarray(count, np.int64) + SMOOTH
    first, rest = divmod(31_250 * count, whole)
    return 1 + 32_000 * first + 32_000 * rest // whole


def intersect(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and in ``b`` of the values that both sorted arrays hold.

    The shorter array is gone through in strides; for each, the place in the longer one is
    found by steps that double until they pass the stride's last value.
    """
    if len(a) > len(b):
        second, first = intersect(b, a)
        return first, second
    mine, theirs, low = [], [], 0
    for start in range(0, len(a), 256):
        part, step = a[start:start + 256], 256
        while low + step < len(b) and b[low + step] < part[-1]:
            step *= 2
        high = min(low + step + 1, len(b))
        at = low + np.searchsorted(b[low:high], part)
        there = at < high
        there[there] = b[at[there]] == part[there]
        mine.append(start + np.flatnonzero(there))
        theirs.append(at[there])
        low = int(at[-1])
    empty = [np.zeros(0, np.int64)]
    return np.concatenate(mine or empty), np.concatenate(theirs or empty)


def merge_block(a: tuple, b: tuple, total_a: int, total_b: int, terms: int) -> tuple[int, int]:
    """(sum of price differences, number of terms) over what either side of a block has.

    A side is its (sorted term ids, counts).
    """
    none_a, none_b = (int(price(np.zeros(1, np.int64), t, terms)[0]) for t in (total_a, total_b))
    price_a, price_b = price(a[1], total_a, terms), price(b[1], total_b, terms)
    i, j = intersect(a[0], b[0])
    both = int(np.abs(price_a[i] - price_b[j]).sum())
    only_a = int(np.abs(np.delete(price_a, i) - none_b).sum())
    only_b = int(np.abs(np.delete(price_b, j) - none_a).sum())
    return both + only_a + only_b, len(a[0]) + len(b[0]) - len(i)


def _side(ids: pa.Scalar, counts: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    if ids.values is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return ids.values.to_numpy(), counts.values.to_numpy()


def _merging():
    @F.arrow_udf("struct<value:long,n_terms:long>")
    def merged(ids_a: pa.Array, n_a: pa.Array, ids_b: pa.Array, n_b: pa.Array,
               total_a: pa.Array, total_b: pa.Array, terms: pa.Array) -> pa.Array:
        sums = zip(total_a.to_pylist(), total_b.to_pylist(), terms.to_pylist())
        done = [merge_block(_side(i, m), _side(j, n), *x) for i, m, j, n, x in zip(ids_a, n_a, ids_b, n_b, sums)]
        return pa.array([{"value": v, "n_terms": n} for v, n in done], pa.struct([("value", pa.int64()), ("n_terms", pa.int64())]))

    return merged


def _price(count, total, terms):
    """The same price as an expression."""
    return F.expr(f"1 + (cast({SCALE} as decimal(20)) * ({count} + {SMOOTH})) div ({total} + {SMOOTH} * {terms})")


def group_prices(counts: DataFrame, min_docs: int) -> tuple[DataFrame, DataFrame]:
    """(groups, entries).  ``groups``: lang, source, terms (V), total (N).  ``entries``: lang, source,
    id, term, n, lang_n: what each group has of the kept terms, numbered in order."""
    per_term = counts.where("term IS NOT NULL").groupBy("lang", "term").agg(
        F.sum("n").alias("lang_n"), F.sum("n_docs").alias("d")).where(F.col("d") >= min_docs)
    kept = staged(numbered(per_term.select("lang", "term", "lang_n"), F.struct("lang", "term"), "id"))
    entries = staged(counts.join(kept, ["lang", "term"]).select("lang", "source", "id", "term", "n", "lang_n"))
    terms = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("lang_n").alias("lang_total"))
    totals = entries.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    none = F.lit(0).cast("long")
    groups = counts.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(
        terms, "lang", "left").select("lang", "source", *[F.coalesce(c, none).alias(c) for c in ("total", "terms", "lang_total")])
    return staged(groups), entries


def pair_values(groups: DataFrame, entries: DataFrame, block: int = BLOCK) -> DataFrame:
    """(lang, a, b, value) for each unordered pair of groups of a language, a before b."""
    ship(groups.sparkSession)
    mine = groups.select("lang", F.col("source").alias("a"), F.col("total").alias("total_a"), "terms")
    theirs = groups.select("lang", F.col("source").alias("b"), F.col("total").alias("total_b"))
    pairs = staged(mine.join(theirs, "lang").where("a < b"))
    blocks = staged(entries.groupBy("lang", "source", F.floor(F.col("id") / block).alias("block")).agg(
        F.sort_array(F.collect_list(F.struct("id", "n"))).alias("e")).select("lang", "source", "block", "e.id", "e.n"))
    key = ["lang", "a", "b", "block"]
    sides = [blocks.withColumnsRenamed({"source": x, "id": f"id_{x}", "n": f"n_{x}"}).join(
        pairs.select("lang", "a", "b"), ["lang", x]) for x in "ab"]
    # where a pair's language keeps no term, there is no block either
    merged = (sides[0].join(sides[1], key, "full").join(pairs, ["lang", "a", "b"])
              .withColumn("found", _merging()("id_a", "n_a", "id_b", "n_b", "total_a", "total_b", "terms")))
    sums = merged.groupBy("lang", "a", "b").agg(F.sum("found.value").alias("some"), F.sum("found.n_terms").alias("n"))
    absent = F.when(F.col("terms") > 0, F.abs(_price(0, "total_a", "terms") - _price(0, "total_b", "terms"))
                    * (F.col("terms") - F.coalesce("n", F.lit(0)))).otherwise(0)
    return pairs.join(sums, ["lang", "a", "b"], "left").select(
        "lang", "a", "b", (F.coalesce("some", F.lit(0)) + absent).cast("long").alias("value"))


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
          min_docs: int = 30, top_terms: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: the distance to every other source of the language.  Part ``term``: the
    ``top_terms`` terms that the source prices highest above its language.
    """
    columns = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n)
               for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))]
    counts = staged(count_terms(docs.select(*columns)).groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("n_docs").alias("n_docs")))
    groups, entries = group_prices(counts, min_docs)
    values = staged(pair_values(groups, entries))
    both = values.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(
        values.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = entries.join(groups, ["lang", "source"]).select("lang", "source", F.col("term").alias("item"), (
        _price("n", "total", "terms") - _price("lang_n", "lang_total", "terms")).cast("long").alias("value"))
    ranked = above.where("value > 0").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_terms)
    out = ["lang", "source", "part", "item", "value", "rank"]
    return both.withColumns({"part": F.lit("pair"), "rank": F.row_number().over(order)}).select(out).unionByName(
        ranked.withColumn("part", F.lit("term")).select(out))
