"""Sharding by sampled splitters: shards of nearly equal size in bytes.

Records are ordered by (hash of the text, hash of the id, id), so equal texts are neighbours.

1. A sample is drawn in which a record's chance is proportional to its size; its quantiles are
   the splitters of about ``ranges`` ranges.  Splitters are pairs of both hashes, so a text
   that a third of all rows carry is cut by as many splitters as its size deserves.
2. Exact bytes and rows per range are counted.  Ranges with more than twice their share of
   either are sampled again by themselves and subdivided.
3. Prefix sums over the ranges, then inside each range, give every record its exact position
   in bytes and rows.  Shard ``s`` takes the positions from s/n to (s+1)/n of all bytes.  A
   group of equal texts stays whole unless it is larger than 1/64 of a shard, also where a
   splitter cuts it: its bytes are then summed over its ranges.

The driver holds the sample (at most about ``SAMPLE`` records per range, of at most
``MAX_RANGES`` ranges), the counts per range, and the groups that splitters cut.

Defined cases: a null text has size 1 and the checksum of the empty text.  An empty text has
size 1 too.  Null ids are ordered first.  Repeated rows are records of their own.  An empty
table gives an empty result.  Other columns take no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .common import staged

SAMPLE = 16
MAX_RANGES = 4096
RANGE_BYTES = 32 << 20
WHOLE_GROUP = 64
SEED = "shard-1"
ROW_BITS = 24


def records(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Narrow records: doc_id, size, text_crc32, the order keys k and h, and g, by which ranges are cut.

    g is h but for its last bits, which a row's number makes: equal rows of one id can be sampled,
    and cut, like any others.  Where a range ends among rows equal in k and h, these are alike.
    """
    data = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    doc_id = F.col(id_col)
    return docs.select(
        doc_id.alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"),
        F.crc32(data).alias("text_crc32"), F.xxhash64(data).alias("k"),
        F.xxhash64(F.lit(SEED), doc_id).alias("h")).withColumn("g", F.shiftleft(F.shiftright("h", ROW_BITS), ROW_BITS).bitwiseOR(
            F.shiftrightunsigned(F.xxhash64(F.monotonically_increasing_id()), 64 - ROW_BITS)))


def _splitters(sample: list, ranges: int) -> list[tuple[int, int]]:
    """Quantiles of a weighted sample of (k, g, weight), without the ends."""
    sample = sorted(sample)
    upto = np.cumsum([w for _, _, w in sample])
    if not len(upto):
        return []
    at = np.searchsorted(upto, upto[-1] * np.arange(1, ranges) / ranges)
    return sorted({tuple(sample[i][:2]) for i in at})


def _drawn(rows: DataFrame, weight, wanted: int) -> list:
    """Records by chance ``weight * wanted``; a record surer than 1 carries the excess along."""
    chance = weight * F.lit(float(wanted))
    dice = F.shiftrightunsigned(F.xxhash64("g", "k", "size"), 11) / F.lit(float(1 << 53))
    return [(r.k, r.g, r.w) for r in rows.where(dice < chance).select(
        "k", "g", F.greatest(chance, F.lit(1.0)).alias("w")).collect()]


def range_of(k: np.ndarray, h: np.ndarray, splitters: np.ndarray) -> np.ndarray:
    """Number of splitters (sorted pairs) that are not above each (k, h)."""
    ks, hs = splitters[:, 0], splitters[:, 1]
    low, high = np.searchsorted(ks, k, "left"), np.searchsorted(ks, k, "right")
    out = low.copy()
    tied = np.flatnonzero(low < high)
    for key in np.unique(k[tied]):
        rows = tied[k[tied] == key]
        a, b = low[rows[0]], high[rows[0]]
        out[rows] = a + np.searchsorted(hs[a:b], h[rows], "right")
    return out


def _ranged(rows: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    table = rows.sparkSession.sparkContext.broadcast(np.array(splitters, np.int64).reshape(-1, 2))

    @F.pandas_udf("int")
    def place(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(range_of(k.to_numpy(), h.to_numpy(), table.value).astype(np.int32))

    return rows.withColumn("range", place("k", "g"))


def ranged(rows: DataFrame, shards: int) -> tuple[DataFrame, list]:
    """Records with their range, and (range, bytes, rows) per range, none overfull that can be cut."""
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    n, total = max(n, 1), max(total, 1)
    ranges = min(MAX_RANGES, max(4 * shards, total // RANGE_BYTES))
    splitters = _splitters(_drawn(rows, F.col("size") / total, SAMPLE * ranges), ranges)
    while True:
        placed = staged(_ranged(rows, splitters))
        counts = sorted(tuple(r) for r in placed.groupBy("range").agg(
            F.sum("size"), F.count(F.lit(1))).collect())
        over = {r: max(b / total, c / n) * ranges for r, b, c in counts
                if c > 1 and max(b / total, c / n) * ranges > 2}
        if not over:
            return placed, counts
        inside = placed.where(F.col("range").isin(list(over)))
        weight = (F.col("size") / total + F.lit(1.0 / n)) / 2
        sample: dict[int, list] = {r: [] for r in over}
        bounds = np.array(splitters, np.int64).reshape(-1, 2)
        for k, h, w in _drawn(inside, weight, 2 * SAMPLE * ranges):
            sample[int(range_of(np.array([k]), np.array([h]), bounds)[0])].append((k, h, w))
        finer = set(splitters).union(*[_splitters(s, int(2 * over[r]) + 1) for r, s in sample.items()])
        if len(finer) == len(splitters):
            return placed, counts
        splitters = sorted(finer)


def _cut_groups(placed: DataFrame, sizes: dict[int, int], firsts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(k, bytes, start) of the groups that a splitter cuts: they end one range and begin the next."""
    edges = sorted(tuple(r) for r in placed.groupBy("range").agg(F.min("k"), F.max("k")).collect())
    cut = sorted({a[2] for a, b in zip(edges, edges[1:]) if a[2] == b[1]})
    if not cut:
        return []
    table = placed.sparkSession.createDataFrame([(k,) for k in cut], "_k long")
    found: dict[int, list] = {}
    for k, r, size in sorted(tuple(x) for x in placed.join(F.broadcast(table), F.col("k") == F.col("_k"))
                             .groupBy("k", "range").agg(F.sum("size")).collect()):
        found.setdefault(k, []).append((r, size))
    return [(k, sum(b for _, b in parts), firsts[r] + sizes[r] - size)
            for k, parts in found.items() for r, size in parts[:1]]


def shard(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    spark = docs.sparkSession
    ship(spark)
    placed, counts = ranged(staged(records(docs, id_col, text_col)), shards)
    total = sum(b for _, b, _ in counts)
    byte, row, firsts = 0, 0, []
    for r, b, c in counts:
        firsts.append((r, byte, row))
        byte, row = byte + b, row + c
    offsets = spark.createDataFrame(firsts, "range int, first_byte long, first_row long")
    cut = spark.createDataFrame(
        _cut_groups(placed, {r: b for r, b, _ in counts}, {r: b for r, b, _ in firsts}),
        "_cut long, _cut_bytes long, _cut_start long")
    order = Window.partitionBy("range").orderBy(
        "k", "h", F.asc_nulls_first("doc_id"), "size", "text_crc32")
    group = Window.partitionBy("range", "k")
    whole = F.col("_group") * (WHOLE_GROUP * shards) <= total
    middle = F.when(whole, 2 * F.col("_group_start") + F.col("_group")).otherwise(
        2 * F.col("_start") + F.col("size"))
    laid = (placed.join(F.broadcast(offsets), "range")  # a row for each range, whose number is bounded
            .withColumn("_start", F.col("first_byte") + F.sum("size").over(
                order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
            .withColumn("_row", F.col("first_row") + F.row_number().over(order) - 1)
            .join(F.broadcast(cut), F.col("k") == F.col("_cut"), "left")  # at most a row for each splitter
            .withColumn("_group", F.coalesce("_cut_bytes", F.sum("size").over(group)))
            .withColumn("_group_start", F.coalesce("_cut_start", F.min("_start").over(group)))
            .withColumn("shard", F.least(F.floor(middle * shards / F.lit(2.0 * max(total, 1))),
                                         F.lit(shards - 1)).cast("int")))
    laid = staged(laid.select("doc_id", "size", "text_crc32", "shard", "_row"))
    heads = laid.groupBy("shard").agg(F.min("_row").alias("_head"))
    return laid.join(F.broadcast(heads), "shard").select(  # a row for each shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("_row") - F.col("_head")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write ``docs`` as one folder ``shard=<number>`` each; ids must be unique.

    Of the columns of ``docs`` none may be called ``shard`` in any case, which is the folders' name.
    """
    if "shard" in {c.lower() for c in docs.columns}:
        raise ValueError("a column is called like the folders: shard")
    names = [f"c{i}" for i in range(len(docs.columns))]
    places = shard(docs, shards, id_col, text_col).select(F.col("doc_id").alias("of"), "shard", "slot")
    placed = docs.toDF(*names).join(places, F.col(names[docs.columns.index(id_col)]).eqNullSafe(F.col("of")))
    placed = (placed.repartition("shard", F.floor(F.col("slot") / 100_000)).sortWithinPartitions("shard", "slot")
              .select(*names, "shard").toDF(*docs.columns, "shard"))
    placed.write.partitionBy("shard").parquet(path)
