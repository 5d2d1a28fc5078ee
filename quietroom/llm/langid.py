"""Language identification in two steps: family first, then close relatives.

Letters of a text, in lower case, give hashed counts of 1, 2 and 3 neighbouring bytes.  Linear
support vector machines, one for each pair of families, choose the family; machines for each
pair of languages inside it choose the language.  The more pairs won, the better; equal
numbers are decided by the sum of margins.  The score is the least certain of the won pairs,
family and language multiplied, on a logistic scale.

The machines are fitted on the driver from a sample of labelled rows: at most about
``sample_rows`` in all, spread evenly over the languages, drawn by a hash of the id; the text
of a sampled row is read whole.  Only rows for which ``may_learn`` holds are used.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is every text
if there is nothing to learn from.  If only one language is known, it is the answer, with
score 1.  Languages without a known family form families of their own.  Repeated rows are
judged alike.  An empty table gives an empty result.  Other columns take no part.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shipping import ship
from .common import held_out, may_learn
from .svm import fit_slope, fit_svm

UNKNOWN = "und"
DIM = 2048
SAMPLE_ROWS = 2400
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "yi", "lb"),
    "romance": ("fr", "es", "it", "pt", "ca", "ro", "gl", "oc", "la"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz", "tk"),
    "indic": ("hi", "mr", "ne", "bn", "gu", "pa", "ur"),
    "semitic": ("ar", "he", "mt", "am"),
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs}
_NO_LETTER = bytes(c if chr(c).isalpha() or c >= 128 else 32 for c in range(256))


def features(text: str | None) -> np.ndarray | None:
    """Hashed n-gram frequencies of unit length; None for a text without a letter."""
    if not text or not any(map(str.isalpha, text)):
        return None
    b = np.frombuffer(b" " + text.lower().encode().translate(_NO_LETTER) + b"  ", np.uint8).astype(np.uint32)
    one, two, three = b[:-2], b[1:-1], b[2:]
    keep = (one != 32) | (two != 32)
    one, two, three = one[keep], two[keep], three[keep]
    grams = (one, one << 8 | two | 1 << 24, one << 16 | two << 8 | three | 2 << 24)
    counts = np.zeros(DIM)
    for g in grams:
        counts += np.bincount((g * np.uint32(2654435761)) >> np.uint32(21), minlength=DIM)
    counts = np.sqrt(counts)
    return (counts / np.linalg.norm(counts)).astype(np.float32)


@dataclass
class Pairs:
    """Machines for each pair of ``names``; a positive margin speaks for the first."""

    names: list[str]
    pairs: list[tuple[int, int]]
    weights: np.ndarray
    slopes: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray) -> "Pairs":
        names = sorted(set(y))
        pairs = list(itertools.combinations(range(len(names)), 2))
        weights, slopes = np.zeros((len(pairs), x.shape[1] + 1)), np.ones(len(pairs))
        for n, (a, b) in enumerate(pairs):
            rows = np.flatnonzero((y == names[a]) | (y == names[b]))
            sign = np.where(y[rows] == names[a], 1.0, -1.0)
            weights[n] = fit_svm(x[rows], sign)
            slopes[n] = fit_slope(x[rows] @ weights[n][:-1] + weights[n][-1], sign)
        return Pairs(names, pairs, weights, slopes)

    def choose(self, x: np.ndarray) -> tuple[str, float]:
        if not self.pairs:
            return self.names[0], 1.0
        margins = self.slopes * (self.weights[:, :-1] @ x + self.weights[:, -1])
        won, total = np.zeros(len(self.names)), np.zeros(len(self.names))
        for m, (a, b) in zip(margins, self.pairs):
            won[a if m >= 0 else b] += 1
            total[a] += m
            total[b] -= m
        best = max(range(len(self.names)), key=lambda i: (won[i], total[i], -i))
        least = min(m if a == best else -m for m, (a, b) in zip(margins, self.pairs) if best in (a, b))
        return self.names[best], float(1 / (1 + np.exp(-np.clip(least, -30, 30))))


@dataclass
class Model:
    families: Pairs | None
    inside: dict[str, Pairs]

    def predict(self, text: str | None) -> tuple[str, float]:
        x = features(text) if self.families else None
        if x is None:
            return UNKNOWN, 0.0
        family, p = self.families.choose(x)
        lang, q = self.inside[family].choose(x)
        return lang, p * q


def fit(docs: DataFrame, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> Model:
    ship(docs.sparkSession)
    rows = docs.where(may_learn(F.col(id_col)) & F.col(lang_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(sample_rows)
    per = {r.lang: r["count"] for r in counts.collect()}  # at most sample_rows languages
    if not per:
        return Model(None, {})
    each = max(1, sample_rows // len(per))
    chance = F.create_map(*itertools.chain(*((F.lit(k), F.lit(min(1.0, each / n))) for k, n in per.items())))
    # rows are drawn by id and text, so that one id on very many rows is not drawn with all or none of them
    roll = F.xxhash64(F.lit("langid"), "id", "text")
    dice = F.shiftrightunsigned(roll, 11) / F.lit(float(1 << 53))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set = set()  # a row that is repeated is learned from once
        for pdf in batches:
            new = [key not in seen and not seen.add(key) for key in zip(pdf["roll"], pdf["lang"])]
            pdf = pdf[new]
            xs = [features(t) for t in pdf["text"]]
            pdf = pd.DataFrame({"id": pdf["id"].astype(str), "lang": pdf["lang"], "roll": pdf["roll"],
                                "x": [None if x is None else x.tobytes() for x in xs]})
            yield pdf[pdf["x"].notna()]

    drawn = rows.withColumn("roll", roll).where(dice < F.coalesce(F.element_at(chance, F.col("lang")), F.lit(0.0)))
    # chance draws about sample_rows; never are more than twice as many taken
    sample = (drawn.mapInPandas(run, "id string, lang string, roll long, x binary").dropDuplicates(["roll", "lang"])
              .orderBy("roll", "lang").limit(2 * sample_rows).collect())
    if not sample:
        return Model(None, {})
    sample.sort(key=lambda r: (r.lang, r.id, r.x))
    x = np.array([np.frombuffer(r.x, np.float32) for r in sample], np.float64)
    lang = np.array([r.lang for r in sample], object)
    family = np.array([_FAMILY.get(v, f"={v}") for v in lang], object)
    return Model(Pairs.fit(x, family), {f: Pairs.fit(x[family == f], lang[family == f]) for f in set(family)})


def identify(docs: DataFrame, model: Model | None = None, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row; the model is fitted here unless given."""
    spark = docs.sparkSession
    known = spark.sparkContext.broadcast(model or fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col))
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [known.value.predict(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "held_out": pdf["held_out"],
                                "lang_pred": [f[0] for f in found], "score": [f[1] for f in found]})

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                       F.col(text_col).alias("text"))
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None = None, least: float = 0.0,
                    id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is identified with a score of at least
    ``least``.  The test runs inside the scan: nothing is shuffled."""
    known = docs.sparkSession.sparkContext.broadcast(
        model or fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col))

    @F.pandas_udf("boolean")
    def identified(text: pd.Series) -> pd.Series:
        found = (known.value.predict(t) for t in text)
        return pd.Series([lang != UNKNOWN and score >= least for lang, score in found], dtype=bool)

    return docs.where(identified(F.col(text_col)))
