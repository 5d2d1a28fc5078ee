"""Exact deduplication through an extendible-hash index on shared files.

Texts are equal when they are identical after every run of white space (blank, tab, line
feed, VT, FF, carriage return) has become one blank.  Of equal texts the row with the smallest
``doc_id`` stays.

1. Normalised texts are written once with their hash.  A directory of hash prefixes is laid over the
   hashes: a bucket with more than ``capacity`` keys is split by one more bit, which doubles the
   directory when it was at full depth.
2. Rows are filed under the bucket their slot of the directory names, and go to the bucket's owner, one
   task.  Copies of a text with more than a thousandth of all rows are combined inside each map task
   first, so that a text that a third of all rows carry arrives as one row.  The owner chains
   the texts of a hash, tells them apart by their bytes, chooses the row that stays and writes its part
   of the index to the shared folder.
3. Rows look their text up by slot: the directory gives the bucket, hash and chain the entry.  Where a
   chain holds several texts, the digest of the bytes says which.  Entries with more than a
   thousandth of all rows number fewer than a thousand, so these are broadcast; all others meet
   in a shuffle by bucket and hash.

The directory is broadcast: ``capacity`` grows with the keys, so that it has no more than some hundred
thousand slots, and no bucket is split more than ``MORE_BITS`` times; one that is still too full (equal
hashes) overflows.
Everything is DataFrame functions; what the driver sees are counts.

Defined cases: a null text counts as empty, and an empty text is a text like any other.  A
null ``doc_id`` is larger than every other; where a group has no other, ``keep_id`` is null and
its rows stay.  Repeated rows (same id, equal text) are one document: each carries the same
decision, and ``deduplicate`` leaves one of them.  An empty table gives an empty result.
Other columns, whatever their names, take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, log2_parts, staged

#: Runs that are not one blank already: replacing only these gives the same text sooner.
_RUN = r"[\t-\r][ \t-\r]*| [ \t-\r]+"
CAPACITY, MAX_BUCKETS, MORE_BITS = 500, 200_000, 6


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _RUN, " ")


def _hash(norm: Column, bits: int) -> Column:
    h = F.xxhash64(norm)
    return h if bits == 64 else F.shiftleft(F.shiftrightunsigned(h, 64 - bits), 64 - bits)


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


@dataclass
class Index:
    """``entries``: bucket, h, chain, chain_length, keep_id, group_size, text_sha256.
    ``directory``: slot, bucket, depth; ``depth`` bits of the hash give the slot.
    ``rows``: id, h, norm, as filed; ``hot``: the hashes of more than a thousandth of the rows."""

    entries: DataFrame
    directory: DataFrame
    depth: int
    rows: DataFrame
    hot: DataFrame

    def located(self, rows: DataFrame) -> DataFrame:
        """Add the bucket that the directory names for column ``h``."""
        return rows.withColumn("slot", _prefix(F.col("h"), self.depth)).join(
            F.broadcast(self.directory.select("slot", "bucket")), "slot").drop("slot")


def build_directory(keys: DataFrame, capacity: int) -> tuple[DataFrame, int]:
    """Directory over column ``h`` of distinct keys, by splitting overfull buckets.

    Starts at the depth that evenly spread keys need (a bulk load) and splits from there.  A
    bucket whose keys all share one hash cannot be split and overflows.
    """
    n = keys.count()
    depth = log2_parts(n, max(1, int(capacity * 0.7)))
    most = depth + MORE_BITS
    leaves, rest = None, keys.select("h")
    while True:
        filled = staged(rest.groupBy(_prefix(F.col("h"), depth).alias("slot")).agg(
            F.count(F.lit(1)).alias("n_keys"), F.min("h").alias("lo"), F.max("h").alias("hi")))
        over = (F.col("n_keys") > capacity) & (F.col("lo") != F.col("hi")) & F.lit(depth < most)
        done = filled.where(~over).select("slot", F.lit(depth).alias("local"))
        leaves = done if leaves is None else leaves.union(done)
        if filled.where(over).isEmpty():
            break
        split = filled.where(over).select(F.col("slot").alias("_slot"))
        rest = rest.join(split, _prefix(F.col("h"), depth) == F.col("_slot"), "left_semi")
        depth += 1
    span = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(depth) - F.col("local"))
    first = F.col("slot") * span
    directory = leaves.select(
        F.explode(F.sequence(first, first + span - 1)).alias("slot"),
        first.alias("bucket"), F.col("local").alias("depth"))
    return staged(directory), depth


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY, hash_bits: int = 64) -> Index:
    """File all distinct normalised texts.  ``hash_bits`` is lowered only to test chaining."""
    norm = normalised(F.col(text_col))
    rows = staged(docs.select(F.col(id_col).alias("id"), norm.alias("norm"))
                  .withColumn("h", _hash(F.col("norm"), hash_bits)))
    keys = staged(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")))
    known, total = keys.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    directory, depth = build_directory(keys, max(capacity, known // MAX_BUCKETS))
    hot = staged(keys.where(F.col("n") > max(1_000, total // 1_000)).select("h"))
    index = Index(None, directory, depth, rows, hot)

    filed = index.located(rows).select("bucket", "h", "norm", "id", F.lit(1).cast("long").alias("n"))
    if not hot.isEmpty():
        many = filed.join(F.broadcast(hot), "h", "left_semi").groupBy("bucket", "h", "norm").agg(
            F.min("id").alias("id"), F.sum("n").alias("n"))
        filed = filed.join(F.broadcast(hot), "h", "left_anti").select("bucket", "h", "norm", "id", "n").unionByName(many)
    # from here on a bucket stays with its owner: what follows is keyed by bucket first
    owned = filed.repartition("bucket").groupBy("bucket", "h", "norm").agg(
        F.min("id").alias("keep_id"), F.sum("n").alias("group_size"))
    chain = Window.partitionBy("bucket", "h")
    sha = F.sha2(F.col("norm").cast("binary"), 256)
    index.entries = staged(owned.select("bucket", "h", "keep_id", "group_size", sha.alias("text_sha256")).select(
        "*", F.row_number().over(chain.orderBy(F.asc_nulls_last("keep_id"), "text_sha256")).alias("chain"),
        F.count(F.lit(1)).over(chain).alias("chain_length")))
    return index


_FOUND = ["keep_id", "group_size", "text_sha256"]


def find_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, h."""
    return look_up(build_index(docs, id_col, text_col, capacity, hash_bits))


def look_up(index: Index) -> DataFrame:
    """``find_copies`` for the rows that were filed."""
    probes = index.located(index.rows.select(F.col("id").alias("doc_id"), "h"))
    alone = index.entries.where("chain_length = 1").select("bucket", "h", *_FOUND)
    hot = F.broadcast(index.hot)
    few = F.broadcast(alone.join(hot, "h", "left_semi").select("bucket", "h", *_FOUND))
    key = ["bucket", "h"]
    found = probes.join(few, key).unionByName(
        probes.join(hot, "h", "left_anti").join(alone, key), allowMissingColumns=True)
    several = index.entries.where("chain_length > 1")
    if not several.isEmpty():
        digest = F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
        chained = staged(several.select(*key).distinct())
        asked = index.located(index.rows).join(chained, key, "left_semi").select(
            "bucket", "h", F.col("id").alias("doc_id"), digest)
        found = found.unionByName(asked.join(several.select(*key, *_FOUND), [*key, "text_sha256"]))
    return found.drop("bucket").withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                capacity: int = CAPACITY, hash_bits: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    def key(sha: Column, doc_id: Column) -> Column:
        return F.concat_ws(":", sha, doc_id.cast("string"))

    index = build_index(docs, id_col, text_col, capacity, hash_bits)
    kept = staged(look_up(index).where("kept")
                  .select(key(F.col("text_sha256"), F.col("doc_id")).alias("_key")).distinct())
    discard(index.rows)
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))
    sha = F.sha2(normalised(F.col(at[text_col])).cast("binary"), 256)
    rows = docs.toDF(*names).withColumn("_key", key(sha, F.col(at[id_col])))
    stay = rows.join(kept, "_key", "left_semi").dropDuplicates(["_key"])
    return stay.select(*names).toDF(*docs.columns)
