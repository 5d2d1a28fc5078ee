import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quietroom.llm import topk


def brute(rows, k, every):
    ok = [(i, [math.floor(256.0 * float(np.float32(x))) for x in v]) for i, v in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if i % every == 0:
            queries[i] = min(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in ok if i != q and len(w) == len(v))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(4096, 1024), (7, 3)])
def test_against_brute_force(spark, blocks, monkeypatch):
    monkeypatch.setattr(topk, "BLOCKS_PER_TASK", 2)
    chance = np.random.default_rng(2)
    rows = [(i, [float(x) for x in chance.normal(0, 0.2, 8)]) for i in range(120)]
    rows += [(200 + i, rows[3][1]) for i in range(30)]                      # many equal vectors
    rows += [(300, None), (301, [1.0, None] + [0.0] * 6), (302, [float("nan")] * 8), (305, [float("inf")] + [0.0] * 7)]
    rows += [(310, [0.5, 0.5]), (311, [0.25, -0.5]), (320, []), (None, [0.1] * 8), (7, rows[7][1]), (10, rows[10][1])]
    rows += [(330, [-3.0] * 8)]
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, id string, v string")
    got = topk.top_k(df, F.col("id") % 10 == 0, k=5, block_rows=blocks[0], query_rows=blocks[1])
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, 5, 10)


def test_large_components_stay_exact(spark):
    rows = [(i, [2.0 ** 18 * (i + 1), 3.0, 1.0 + i]) for i in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.top_k(df, F.col("id") % 5 == 0, k=4)
    assert sorted(tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()) == brute(rows, 4, 5)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.top_k(df, F.col("id") % 50 == 0).count() == 0
