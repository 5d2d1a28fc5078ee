"""Quality scores: random Fourier features, ridge regression, isotonic calibration.

1. Every whole text is reduced to the statistics ``STATS``; the narrow table is staged.
2. Statistics are standardised, and random Fourier features approximate a Gaussian kernel over
   them: sqrt(2/D)·cos(Wx + b) with a fixed seed.
3. Each partition of the labelled rows sums its part of the normal equations Z'Z and Z'y; the
   sums meet in two steps, and the driver solves one D x D system.
4. Ridge scores of the labelled rows are counted in ``BINS`` bins, and pooling adjacent
   violators over the bins gives a rising curve from score to probability.

All labelled rows for which ``may_learn`` holds are used; nothing is sampled.  The driver
holds D x D sums from at most ``SUMS`` tasks, and the bins.

Defined cases: null and empty texts have statistics of zero and are scored.  Null labels are
ignored; several labels of a document are averaged.  Without labels all scores are 0.5.
Repeated rows are scored alike.  An empty table gives an empty result.  Other columns take no
part.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .common import held_out, may_learn, staged

STATS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "distinct_words", "top_word",
    "repeated_neighbours", "log_lines", "line_length", "repeated_lines", "upper", "digits",
    "sentence_marks", "symbols", "bangs", "bars", "white", "beyond_ascii", "entropy", "short_words",
    "upper_words", "marked_words", "bar_lines", "loud_lines", "worst_line", "capital_starts",
)
FEATURES = 256
RIDGE = 1e-3
BINS = 1000
SUMS = 8
_LINE_MARKS = re.compile(rb"[!#$%&*]")


def statistics(text: str | None) -> list[float]:
    data = (text or "").encode()
    words = data.split()
    if not words:
        return [math.log1p(len(data))] + [0.0] * (len(STATS) - 1)
    b = np.frombuffer(data, np.uint8)
    seen = np.bincount(b, minlength=256)
    size, n = len(b), len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    counts = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    line_counts = Counter(lines)
    share = seen[seen > 0] / size
    marks = [len(_LINE_MARKS.findall(x)) / max(1, len(x.split())) for x in lines]
    upper_words = sum(w.isupper() and len(w) > 1 for w in words)
    return [
        math.log1p(size), math.log1p(n), float(lengths.mean()), float(lengths.std()), len(counts) / n,
        max(counts.values()) / n, sum(a == c for a, c in zip(words, words[1:])) / n,
        math.log1p(len(lines)), math.log1p(size / len(lines)), 1 - len(line_counts) / len(lines),
        seen[65:91].sum() / size, seen[48:58].sum() / size, (seen[44] + seen[46] + seen[63]) / n,
        (seen[35:39].sum() + seen[42] + seen[64]) / n, seen[33] / n, seen[124] / n,
        (seen[32] + seen[9:14].sum()) / size, seen[128:].sum() / size, float(-(share * np.log2(share)).sum()),
        float((lengths <= 2).mean()), upper_words / n,
        sum(not w[-1:].isalnum() and w[-1] < 128 for w in words) / n,
        sum(b"|" in x for x in lines) / len(lines), sum(x.isupper() for x in lines) / len(lines),
        min(3.0, max(marks)), sum(65 <= w[0] <= 90 for w in words) / n,
    ]


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``x``, the statistics in the order of ``STATS``."""
    ship(docs.sparkSession)
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [statistics(t) for t in pdf["text"]]})

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, x array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    directions: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    level: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.cos(np.clip((x - self.mean) / self.scale, -5, 5) @ self.directions + self.phases)
        return np.hstack([z * math.sqrt(2 / z.shape[1]), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.level), 0.0, 1.0)


def pool_adjacent(at: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising step levels for means ``y`` with counts ``n`` at sorted places: (place, level)."""
    pools: list[list[float]] = []
    for a, v, c in zip(at, y, n):
        pools.append([a * c, v * c, c])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            last = pools.pop()
            pools[-1] = [p + q for p, q in zip(pools[-1], last)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64).reshape(len(column), -1)


def _summed(parts: Iterator[np.ndarray]) -> np.ndarray | None:
    total = None
    for p in parts:
        total = p.copy() if total is None else total + p
    return total


def fit(stats: DataFrame, labels: DataFrame, features: int = FEATURES, ridge: float = RIDGE,
        width: float = 3.0, seed: int = 11) -> Model:
    """``stats``: doc_id, x; ``labels``: doc_id, label (0 or 1, null ignored)."""
    spark = stats.sparkSession
    d = len(STATS)
    marks = labels.where(F.col("label").isNotNull()).groupBy("doc_id").agg(F.avg("label").alias("y"))
    rows = staged(stats.join(marks, "doc_id").where(may_learn(F.col("doc_id"))).select("x", "y"))
    sums = rows.agg(F.count(F.lit(1)), *[F.avg(F.col("x")[i]) for i in range(d)],
                    *[F.stddev_pop(F.col("x")[i]) for i in range(d)]).first()
    chance = np.random.default_rng(seed)
    model = Model(np.zeros(d), np.ones(d), chance.normal(0, 1 / width, (d, features)),
                  chance.uniform(0, 2 * math.pi, features), np.zeros(features + 1),
                  np.array([0.0]), np.array([0.5]))
    if not sums[0]:
        return model
    model.mean = np.array(sums[1:d + 1], np.float64)
    model.scale = np.maximum(np.array(sums[d + 1:], np.float64), 1e-6)
    shape = (features + 1, features + 2)
    first = spark.sparkContext.broadcast(model)

    def equations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def parts():
            for pdf in batches:
                z = first.value.features(_matrix(pdf["x"]))
                yield z.T @ np.column_stack([z, pdf["y"].to_numpy(np.float64)])
        total = _summed(parts())
        if total is not None:
            yield pd.DataFrame({"part": [total.tobytes()]})

    def together(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = _summed(np.frombuffer(p).reshape(shape) for pdf in batches for p in pdf["part"])
        if total is not None:
            yield pd.DataFrame({"part": [total.tobytes()]})

    parts = rows.mapInPandas(equations, "part binary").repartition(SUMS).mapInPandas(together, "part binary")
    total = _summed(np.frombuffer(r.part).reshape(shape) for r in sorted(parts.collect()))
    gram, moment = total[:, :-1], total[:, -1]
    penalty = ridge * sums[0] * np.eye(features + 1)
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(gram + penalty, moment)
    fitted = spark.sparkContext.broadcast(model)

    def binned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            raw = fitted.value.raw(_matrix(pdf["x"]))
            yield pd.DataFrame({"bin": np.floor(np.clip((raw + 0.5) / 2, 0, 1) * BINS).astype(np.int64),
                                "raw": raw, "y": pdf["y"]})

    bins = sorted(tuple(r) for r in rows.mapInPandas(binned, "bin long, raw double, y double").groupBy("bin").agg(
        F.avg("raw"), F.avg("y"), F.count(F.lit(1))).collect())
    table = np.array(bins)
    model.at, model.level = pool_adjacent(table[:, 1], table[:, 2], table[:, 3])
    return model


def score(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", features: int = FEATURES) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    stats = staged(document_statistics(docs, id_col, text_col))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("double").alias("label"))
    model = stats.sparkSession.sparkContext.broadcast(fit(stats, marks, features))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            p = model.value.score(_matrix(pdf["x"])) if len(pdf) else np.zeros(0)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"], "score": p,
                                "predicted": (p >= 0.5).astype(np.int32)})

    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = stats.withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
