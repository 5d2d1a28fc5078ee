"""Line deduplication that can be taken back: sharded cuckoo filters over exact reference counts.

A text is split at line feeds.  The key of a line is the line without blanks, tabs, VT, FF, carriage
returns (and line feeds) at both ends, with A-Z lower-cased.  A key of at least ``min_chars`` code
points that at least ``min_docs`` documents of the index hold is common, and all its lines go.

* **Reference counts** say, for every key (by a 128-bit hash of its bytes), in how many documents it
  is.  Inserting documents adds to them, removing documents takes away; only keys whose count
  passes ``min_docs`` on the way up or down matter to the filters.
* **Filters**: keys are dealt over shards by the first bits of their hash, as many shards as the keys
  need.  The task of a shard inserts keys that became common into the shard's cuckoo filter,
  deletes those that no longer are, and, having every key of the shard at hand, lists the uncommon
  ones that the filter takes for common (about one in ten thousand).  Filter and list together
  answer exactly for every document inside the index.
* **Documents** are read once more, and their lines looked up.  Filters are broadcast, up to
  ``round_bytes`` (64 MiB) at a time: where all are larger, shards are taken in several rounds, each
  of which drops the lines that its own shards know.

``insert`` and ``remove`` return a new index and leave the old one as it is, so a step that is
repeated does no harm.  An index after inserting A and B and removing A answers as one of B alone.

Defined cases: a null or empty text is one empty line, which is never dropped.  A document is a row:
repeated rows are documents of their own, whatever their ids.  A document that loses all its
lines keeps the empty text.  Removing documents that are not in the index is an error.  Only
documents inside the index may be looked up.  An empty table gives an empty result.  Other
columns, whatever their names, stay as they are.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shipping import ship
from . import cuckoo
from .common import log2_parts, staged

SPACE = b" \t\n\x0b\x0c\r"
KEYS_PER_SHARD = 50_000
ROUND_BYTES = 64 << 20
_HELD = 200_000  # keys counted in a task before they are handed on


@dataclass
class LineIndex:
    """``counts``: h1, h2, n_docs.  ``filters``: shard, entries, spared; ``bits`` of h1 give the shard."""

    counts: DataFrame
    filters: DataFrame
    bits: int
    min_docs: int
    min_chars: int


def line_keys(text: bytes | None) -> list[bytes]:
    """One key per line; keys that are too short to count are told by ``is_long``."""
    return [line.strip(SPACE) for line in (text or b"").lower().split(b"\n")]


def is_long(key: bytes, min_chars: int) -> bool:
    return len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars)


def _digests(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(joined, "<u8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def count_keys(docs: DataFrame, text_col: str, min_chars: int) -> DataFrame:
    """(h1, h2, n): in how many documents each key is."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            h1, h2 = _digests(b"".join(held))
            n = np.fromiter(held.values(), np.int64, len(held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(n)],
                                              names=["h1", "h2", "n"])

        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                keys = {k for k in set(line_keys(text.as_py())) if k and is_long(k, min_chars)}
                held.update([xxhash.xxh3_128_digest(k) for k in keys])
                if len(held) > _HELD:
                    yield rows()
        if held:
            yield rows()

    texts = docs.select(F.col(text_col).cast("string").alias("text")).where("text <> ''")
    return texts.mapInArrow(run, "h1 long, h2 long, n long").groupBy("h1", "h2").agg(F.sum("n").alias("n"))


def empty_index(spark: SparkSession, min_docs: int = 10, min_chars: int = 1) -> LineIndex:
    if min_docs < 1 or min_chars < 1:
        raise ValueError("min_docs and min_chars start at 1")
    return LineIndex(spark.createDataFrame([], "h1 long, h2 long, n_docs long"),
                     spark.createDataFrame([], _FILTER), 0, min_docs, min_chars)


_FILTER = "shard long, entries binary, spared binary"


def _shard(bits: int) -> Column:
    return F.shiftrightunsigned("h1", 64 - bits) if bits else F.lit(0).cast("long")


def _shard_filter(keys: pd.DataFrame, old: bytes | None, min_docs: int) -> tuple[bytes, bytes]:
    """A shard's filter after a change, and the uncommon keys that it takes for common.

    ``keys``: h1, h2, before, after, all keys of the shard.
    """
    keys = keys.sort_values(["h1", "h2"])
    h1, h2 = (keys[c].to_numpy(np.int64).view(np.uint64) for c in ("h1", "h2"))
    before, after = keys["before"].to_numpy() >= min_docs, keys["after"].to_numpy() >= min_docs
    down, up = before & ~after, after & ~before
    table, fits = None, False
    if old is not None:
        table = np.frombuffer(old, "<u2").reshape(-1, cuckoo.SLOTS).copy()
        cuckoo.delete(table, h1[down], h2[down])
        fits = after.sum() <= table.size * cuckoo.LOAD and cuckoo.insert(table, h1[up], h2[up])
    room = int(after.sum())
    while not fits:
        table = cuckoo.new_table(room)
        fits, room = cuckoo.insert(table, h1[after], h2[after]), 2 * room
    rare = ~after & (keys["after"].to_numpy() > 0)
    h1, h2 = h1[rare], h2[rare]
    zero = np.zeros(len(h1), np.int64)
    wrong = cuckoo.contains(table, zero, zero + len(table) - 1, h1, h2)
    return table.astype("<u2").tobytes(), np.stack([h1[wrong], h2[wrong]], 1).astype("<u8").tobytes()


def _changed(index: LineIndex, docs: DataFrame, text_col: str, sign: int) -> LineIndex:
    deltas = count_keys(docs, text_col, index.min_chars).select("h1", "h2", F.lit(0).cast("long").alias("before"),
                                                                (sign * F.col("n")).alias("change"))
    old = index.counts.select("h1", "h2", F.col("n_docs").alias("before"), F.lit(0).cast("long").alias("change"))
    keys = staged(old.unionByName(deltas).groupBy("h1", "h2").agg(
        F.sum("before").alias("before"), (F.sum("before") + F.sum("change")).alias("after")))
    seen = keys.agg(F.count(F.lit(1)).alias("n"), F.min("after").alias("least")).first()
    if (seen["least"] or 0) < 0:
        raise ValueError("documents to be removed are not in the index")
    bits, min_docs = max(index.bits, log2_parts(seen["n"], KEYS_PER_SHARD)), index.min_docs
    kept = index.filters if bits == index.bits else index.filters.limit(0)

    def update(shard: tuple, mine: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if mine.empty:
            return filters
        had = bytes(filters["entries"].iloc[0]) if len(filters) else None
        entries, spared = _shard_filter(mine, had, min_docs)
        return pd.DataFrame({"shard": [shard[0]], "entries": [entries], "spared": [spared]})

    filters = staged(keys.withColumn("shard", _shard(bits)).groupBy("shard")
                     .cogroup(kept.groupBy("shard")).applyInPandas(update, _FILTER))
    counts = keys.where("after > 0").select("h1", "h2", F.col("after").alias("n_docs"))
    return LineIndex(counts, filters, bits, min_docs, index.min_chars)


def insert(index: LineIndex, docs: DataFrame, text_col: str = "text") -> LineIndex:
    """The index with the documents of ``docs`` added."""
    return _changed(index, docs, text_col, 1)


def remove(index: LineIndex, docs: DataFrame, text_col: str = "text") -> LineIndex:
    """The index without the documents of ``docs``, given as they were inserted."""
    return _changed(index, docs, text_col, -1)


def _rounds(index: LineIndex, limit: int) -> list[DataFrame]:
    """Filters in parts of at most ``limit`` bytes (one shard at least)."""
    size = F.sum(F.length("entries") + F.length("spared"))
    parts, shards = 1, 1 << index.bits
    while True:
        part = F.floor(F.col("shard") * parts / shards)
        most = index.filters.groupBy(part).agg(size.alias("b")).agg(F.max("b")).first()[0] or 0
        if most <= limit or parts >= shards:
            return [index.filters.where(part == i) for i in range(parts)]
        parts *= 2


class _Tables:
    """The filters of one round, laid end to end for looking up many keys at once."""

    def __init__(self, rows: list, bits: int):
        rows = sorted(rows, key=lambda r: r["shard"])
        tables = [np.frombuffer(r["entries"], "<u2").reshape(-1, cuckoo.SLOTS) for r in rows]
        self.bits, self.shards = bits, np.array([r["shard"] for r in rows], np.int64)
        sizes = np.array([len(t) for t in tables], np.int64)
        self.first, self.mask = np.cumsum(sizes) - sizes, sizes - 1
        self.flat = np.concatenate(tables) if tables else np.zeros((0, cuckoo.SLOTS), np.uint16)
        self.spared = {k for r in rows for k in np.frombuffer(r["spared"], "V16").tolist()}

    def common(self, joined: bytes) -> np.ndarray:
        """For each 16-byte digest, whether its key is common by what these shards know."""
        h1, h2 = _digests(joined)
        out = np.zeros(len(h1), bool)
        if not len(self.shards) or not len(h1):
            return out
        shard = (h1 >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(h1), np.int64)
        at = np.minimum(np.searchsorted(self.shards, shard), len(self.shards) - 1)
        known = np.flatnonzero(self.shards[at] == shard)
        at = at[known]
        out[known] = cuckoo.contains(self.flat, self.first[at], self.mask[at], h1[known], h2[known])
        if self.spared:
            for i in np.flatnonzero(out):
                out[i] = joined[16 * i:16 * i + 16] not in self.spared
        return out


def _clean(tables: _Tables, texts: list[bytes | None], min_chars: int) -> list[tuple[int, int, bytes]]:
    """(number of lines, of kept lines, text of the kept lines) for each text."""
    import xxhash

    joined, lines_of = [], []
    for text in texts:
        keys = line_keys(text)
        marks = [bool(k) and is_long(k, min_chars) for k in keys]
        joined += [xxhash.xxh3_128_digest(k) for k, m in zip(keys, marks) if m]
        lines_of.append(marks)
    common, at, out = iter(tables.common(b"".join(joined)).tolist()), 0, []
    for text, marks in zip(texts, lines_of):
        drop = [m and next(common) for m in marks]
        if any(drop):
            kept = [line for line, d in zip(text.split(b"\n"), drop) if not d]
            out.append((len(marks), len(kept), b"\n".join(kept)))
        else:
            out.append((len(marks), len(marks), text or b""))
    return out


_STATE = "struct<n_lines:long,n_kept:long,text:string>"


def _round(tables, min_chars: int):
    """The function that drops the lines one round of shards knows from (n_lines, n_kept, text)."""
    @F.arrow_udf(_STATE)
    def cleaned(rows: pa.Array) -> pa.Array:
        n_lines, n_kept, texts = (rows.field(j) for j in range(3))
        found = _clean(tables.value, texts.cast(pa.binary()).to_pylist(), min_chars)
        # an empty text may be one empty line, or what an earlier round left of a text without lines
        total = [f[0] if n is None else n for n, f in zip(n_lines.to_pylist(), found)]
        kept = [0 if n == 0 else f[1] for n, f in zip(n_kept.to_pylist(), found)]
        return pa.StructArray.from_arrays(
            [pa.array(total, pa.int64()), pa.array(kept, pa.int64()),
             pa.array([f[2] for f in found], pa.binary()).cast(pa.string())], names=["n_lines", "n_kept", "text"])

    return cleaned


def drop_common(docs: DataFrame, index: LineIndex, text_col: str = "text",
                round_bytes: int = ROUND_BYTES) -> DataFrame:
    """``docs`` with one more column, ``lines``: n_lines, n_dropped and the text that is left."""
    spark = docs.sparkSession
    ship(spark)
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = F.col(names[docs.columns.index(text_col)]).cast("string").alias("text")
    unknown = F.lit(None).cast("long")
    out = docs.toDF(*names).withColumn("state", F.struct(unknown.alias("n_lines"), unknown.alias("n_kept"), text))
    parts = _rounds(index, round_bytes)
    for i, part in enumerate(parts):
        tables = spark.sparkContext.broadcast(_Tables(part.collect(), index.bits))
        out = out.withColumn("state", _round(tables, index.min_chars)("state"))
        if i < len(parts) - 1:
            out = staged(out)
    lines = F.struct(F.col("state.n_lines").alias("n_lines"),
                     (F.col("state.n_lines") - F.col("state.n_kept")).alias("n_dropped"), F.col("state.text").alias("text"))
    return out.select(*names, lines.alias("lines")).toDF(*docs.columns, "lines")


def find_common(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10,
                min_chars: int = 1) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept text of every document, by the lines that ``docs`` share."""
    only = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    index = insert(empty_index(docs.sparkSession, min_docs, min_chars), only)
    return drop_common(only, index).select("doc_id", "lines.*")


def deduplicate(docs: DataFrame, text_col: str = "text", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """``docs`` with all their columns, common lines taken out of the texts."""
    index = insert(empty_index(docs.sparkSession, min_docs, min_chars), docs.select(F.col(text_col).alias("text")), "text")
    names = [f"c{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index(text_col)]
    done = drop_common(docs.toDF(*names), index, text)
    return done.withColumn(text, F.col("lines.text")).select(*names).toDF(*docs.columns)
