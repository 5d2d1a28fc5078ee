import numpy as np
import pytest
from pyspark.sql import functions as F

from quietroom.llm import langid, quality, svm
from quietroom.llm.common import held_out


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


def test_svm_separates():
    chance = np.random.default_rng(0)
    x = chance.normal(0, 1, (400, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 0] + 0.3 > 0, 1.0, -1.0)
    w = svm.fit_svm(x, y, cost=100.0)
    assert np.mean(np.sign(x @ w[:-1] + w[-1]) == y) > 0.97
    assert 0.1 <= svm.fit_slope(x @ w[:-1] + w[-1], y) <= 20


def test_language_held_out_accuracy(tables):
    docs, _ = tables
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id")
    assert got.count() == docs.count()
    right = got.where("held_out").groupBy("lang").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).collect()
    assert len(right) == 4 and all(r[1] > 0.97 for r in right)


def test_labels_of_held_out_rows_are_not_used(tables):
    docs, _ = tables
    poisoned = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in {r[0] for r in langid.identify(poisoned).select("lang_pred").distinct().collect()}


def test_language_of_odd_rows(documents, odd, tables):
    model = langid.fit(tables[0], sample_rows=200)
    got = langid.identify(documents(odd, clash=True), model).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    for i in (3, 4, 5):
        assert (by[i].lang_pred, by[i].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 for r in got)
    df = documents(odd, clash=True)
    kept = langid.keep_identified(df, model)
    assert kept.columns == df.columns and kept.count() == len(odd) - 3


def test_language_without_labels(documents):
    df = documents([(1, "abc"), (2, None)])
    assert {r.lang_pred for r in langid.identify(df).collect()} == {"und"}
    assert langid.identify(documents([])).count() == 0
    one = documents([(i, f"abc def {i}", "en") for i in range(20)])
    assert {(r.lang_pred, r.score) for r in langid.identify(one).collect()} == {("en", 1.0)}


def test_quality_held_out(tables):
    docs, labels = tables
    got = quality.score(docs, labels)
    assert got.count() == docs.count()
    rows = got.join(labels, "doc_id").where("held_out").toPandas()
    assert ((rows.score >= 0.5) == (rows.quality == 1)).mean() > 0.95
    assert (rows.predicted == (rows.score >= 0.5)).all() and rows.score.between(0, 1).all()


def test_normal_equations_are_those_of_one_machine(tables):
    docs, labels = tables
    stats = quality.document_statistics(docs)
    marks = labels.select("doc_id", F.col("quality").cast("double").alias("label"))
    model = quality.fit(stats, marks, features=32)
    rows = stats.join(marks, "doc_id").where(~held_out(F.col("doc_id"))).toPandas()
    z = model.features(np.array(rows.x.tolist()))
    penalty = quality.RIDGE * len(z) * np.eye(33)
    penalty[-1, -1] = 0
    assert np.allclose(np.linalg.solve(z.T @ z + penalty, z.T @ rows.label.to_numpy()), model.weights, atol=1e-6)


def test_pool_adjacent_against_min_max_formula():
    chance = np.random.default_rng(5)
    y, n = chance.random(12), chance.integers(1, 9, 12).astype(float)
    _, level = quality.pool_adjacent(np.arange(12.0), y, n)
    mean = lambda i, j: (y[i:j + 1] * n[i:j + 1]).sum() / n[i:j + 1].sum()
    want = [max(min(mean(i, j) for j in range(k, 12)) for i in range(k + 1)) for k in range(12)]
    assert np.allclose(sorted(set(np.round(want, 9))), np.round(level, 9))


def test_quality_of_odd_rows(documents, odd, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score(documents(odd, clash=True), none).collect()
    assert len(got) == len(odd) and {r.score for r in got} == {0.5}
    assert quality.score(documents([]), none).count() == 0
    some = spark.createDataFrame([(1, 1), (8, 0), (8, 0), (9, None)], "doc_id long, quality int")
    assert quality.score(documents(odd), some).count() == len(odd)
