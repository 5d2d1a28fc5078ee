"""Exact top-k inner products by the three-phase uniform threshold method.

A score is a sum over slices of the dimensions; for a query, each slice is a list of partial
scores over all vectors.  Vectors and queries are packed into blocks, and a task meets one
block of queries with several blocks of vectors.

1. Every task gathers, for each query and slice, the vectors with the largest partial scores in
   its blocks, and the exact scores of these.  The k-th largest of all gathered scores is a
   cutoff: at least k vectors reach it.
2. The cutoffs are sent to all tasks with the query blocks.  A vector whose partial score is
   below cutoff/slices in every slice cannot reach the cutoff; the others are collected.  Of
   these, a vector is dropped if it stays below the cutoff even with cutoff/slices in the slices
   where it was not collected.
3. The remaining scores are resolved exactly, and each task passes on its k best per query.

Components become floor(256 * x); where 256 * x is beyond the largest number, the component counts as
non-finite.  Sums are exact: in floating point while all stay below
2^53, else in whole numbers of any size.  A score beyond 64 bits is an error.

Defined cases: vectors that are null or hold null or non-finite components take no part.  Only
vectors of a query's own length are its candidates.  Rows that carry the query's id are not its
candidates; other repeated rows are candidates of their own.  Of repeated queries the smallest
vector asks.  Ties go to the smaller id.  A null id takes no part.  A query without candidates
has no rows.  An empty table gives an empty result.  Other columns take no part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .common import numbered, staged

SLICES = 4
BLOCK_ROWS = 4096
QUERY_ROWS = 1024
BLOCKS_PER_TASK = 16
_PACKED = "dim int, rows int, ids binary, data binary"
_FOUND = "query_block long, query_id long, vec_id long, score long"


def valid(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    # NaN is larger than every number here
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double") * 256.0) < F.lit(float("inf"))))
    return v.where(F.col("id").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))


def _packer(rows: int):
    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, tuple[list, list]] = {}

        def out(dim: int) -> pd.DataFrame:
            ids, vs = held.pop(dim)
            return pd.DataFrame({"dim": [dim], "rows": [len(ids)], "ids": [np.array(ids, np.int64).tobytes()],
                                 "data": [np.floor(256.0 * np.array(vs, np.float64)).tobytes()]})

        for pdf in batches:
            for i, v in zip(pdf["id"], pdf["v"]):
                ids, vs = held.setdefault(len(v), ([], []))
                ids.append(i)
                vs.append(v)
                if len(ids) == rows:
                    yield out(len(v))
        for dim in list(held):
            yield out(dim)
    return pack


def _matrix(data: bytes, rows: int, dim: int) -> np.ndarray:
    return np.frombuffer(data, np.float64).reshape(rows, dim)


def _partials(q: np.ndarray, x: np.ndarray, slices: int) -> list[np.ndarray]:
    """Partial score matrices, one per slice of the dimensions; exact."""
    dim = q.shape[1]
    if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(dim, 1) >= 2.0 ** 53:
        whole = np.vectorize(int, otypes=[object])
        q, x = whole(q), whole(x)
    cuts = np.array_split(np.arange(dim), max(1, min(slices, dim)))
    return [q[:, c] @ x[:, c].T for c in cuts]


class _Best:
    """The k best (score, then smaller id) of each query of each block seen by a task."""

    def __init__(self, k: int):
        self.k, self.held = k, {}

    def add(self, block: int, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        if (block, query) in self.held:
            old_ids, old_scores = self.held[block, query]
            ids, scores = np.concatenate([old_ids, ids]), np.concatenate([old_scores, scores])
        if scores.dtype == object:
            top = sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:self.k]
        else:
            top = np.lexsort((ids, -scores))[:self.k]
        self.held[block, query] = ids[top], scores[top]

    def rows(self) -> pd.DataFrame:
        found = [(b, q, int(i), int(s)) for (b, q), (ids, scores) in self.held.items()
                 for i, s in zip(ids, scores)]
        return pd.DataFrame(found, columns=["query_block", "query_id", "vec_id", "score"])


def _meetings(batches: Iterator[pd.DataFrame], slices: int):
    for pdf in batches:
        for r in pdf.itertuples():
            queries = np.frombuffer(r.query_ids, np.int64)
            ids = np.frombuffer(r.ids, np.int64)
            parts = _partials(_matrix(r.query_data, len(queries), r.dim), _matrix(r.data, len(ids), r.dim), slices)
            yield r, queries, ids, parts


def _gather(k: int, slices: int):
    def phase(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(k)
        for r, queries, ids, parts in _meetings(batches, slices):
            most = min(k + 1, len(ids))  # one more, as the query itself may be among them
            tops = [np.argpartition(-p, most - 1, axis=1)[:, :most] if most < len(ids)
                    else np.tile(np.arange(len(ids)), (len(queries), 1)) for p in parts]
            for i, q in enumerate(queries):
                at = np.unique(np.concatenate([t[i] for t in tops]))
                at = at[ids[at] != q]
                best.add(r.query_block, int(q), ids[at], sum(p[i, at] for p in parts))
        yield best.rows()
    return phase


def _resolve(k: int, slices: int):
    def phase(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _Best(k)
        for r, queries, ids, parts in _meetings(batches, slices):
            known = dict(zip(r.cut_ids, r.cut_scores))
            cut = np.array([known.get(int(q), -math.inf) for q in queries], np.float64)
            # a little lower where floating point is not exact, so that rounding never drops a vector
            cut = np.where(np.abs(cut) < 2.0 ** 52, cut, cut - np.abs(cut) * 2.0 ** -48)
            bound = np.floor(cut / len(parts))[:, None]
            collected = np.logical_or.reduce([p >= bound for p in parts])
            upper = sum(np.maximum(p, bound) for p in parts)
            rest = collected & (upper >= cut[:, None])
            for i, q in enumerate(queries):
                at = np.flatnonzero(rest[i] & (ids != q))
                scores = sum(p[i, at] for p in parts)
                if len(at):
                    reach = scores >= cut[i]
                    best.add(r.query_block, int(q), ids[at[reach]], scores[reach])
        yield best.rows()
    return phase


def _ranked(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
          vector_col: str = "embedding", slices: int = SLICES, block_rows: int = BLOCK_ROWS,
          query_rows: int = QUERY_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score; ``is_query`` is a condition on the column ``id``."""
    ship(vectors.sparkSession)
    rows = staged(valid(vectors, id_col, vector_col))
    asked = rows.where(is_query).groupBy("id").agg(F.min("v").alias("v"))
    n_queries = rows.where(is_query).count()
    data = staged(rows.mapInPandas(_packer(block_rows), _PACKED))
    packed = (asked.repartition(max(1, math.ceil(n_queries / query_rows)))
              .mapInPandas(_packer(query_rows), _PACKED))
    queries = staged(numbered(packed.select("dim", F.col("ids").alias("query_ids"),
                                            F.col("data").alias("query_data")),
                              F.struct("dim", "query_ids"), "query_block"))
    n_blocks, n_data = queries.count(), data.count()
    salts = max(1, math.ceil(n_data / BLOCKS_PER_TASK))
    dealt = data.withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(salts))).withColumn(
        "query_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(max(n_blocks, 1) - 1).cast("long"))))
    copies = queries.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    met = dealt.join(copies, ["dim", "query_block", "salt"])
    gathered = met.mapInPandas(_gather(k, slices), _FOUND)
    cuts = (_ranked(gathered, k).where(F.col("rank") == k).groupBy("query_block")
            .agg(F.collect_list("query_id").alias("cut_ids"), F.collect_list("score").alias("cut_scores")))
    none = F.array().cast("array<long>")
    safe = queries.join(staged(cuts), "query_block", "left").withColumns(
        {c: F.coalesce(c, none) for c in ("cut_ids", "cut_scores")})
    copies = safe.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    found = dealt.join(copies, ["dim", "query_block", "salt"]).mapInPandas(_resolve(k, slices), _FOUND)
    return _ranked(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
