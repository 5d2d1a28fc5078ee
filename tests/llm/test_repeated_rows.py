"""Twenty thousand rows of one id, and columns called like the operators' own."""

import pytest
from pyspark.sql import functions as F

from quietroom.llm import exact_dedup, langid, linededup, mixing, sharding, shingle_join, topk

N = 20_000


@pytest.fixture(scope="module")
def repeated(spark):
    """One id (that may be learned from), one text and one source on all rows but a few."""
    one = spark.range(N).select(F.lit(3).cast("long").alias("doc_id"), F.lit("some words stand here").alias("text"),
                                F.lit("en").alias("lang"), F.lit("s").alias("source"))
    more = spark.range(40).selectExpr("id + 100 AS doc_id", "concat('autres mots ici ', id) AS text", "'fr' AS lang", "'t' AS source")
    return one.unionByName(more)


def test_the_language_sample_is_bounded(repeated, monkeypatch):
    seen = []
    fit = langid.Pairs.fit
    monkeypatch.setattr(langid.Pairs, "fit", classmethod(lambda cls, x, names: (seen.append(len(x)), fit(x, names))[1]))
    model = langid.fit(repeated, sample_rows=100)
    assert max(seen) <= 200
    assert model.families is None or model.predict("autres mots ici")[0] in ("fr", "en")


def test_number_signs_are_no_letters():
    assert langid.features("½ ²") is None and langid.features("Ⅷ ① 12 _") is None
    assert langid.features("½ a") is not None


def test_equal_records_are_sampled_and_cut(repeated):
    rows = sharding.staged(sharding.records(repeated))
    drawn = sharding._drawn(rows, F.col("size") / F.lit(float(rows.agg(F.sum("size")).first()[0])), 1000)
    assert 800 <= len(drawn) <= 1200
    _, counts = sharding.ranged(rows, 16)
    assert len(counts) > 16 and max(c for _, _, c in counts) <= N / 8
    got = sharding.shard(repeated, 16)
    sizes = [r["count"] for r in got.groupBy("shard").count().collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 100
    slots = got.groupBy("shard").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count_distinct("slot").alias("n"))
    assert all(r.lo == 0 and r.hi + 1 == r.n for r in slots.collect())


def test_one_id_lies_in_several_windows(repeated, monkeypatch):
    odd = repeated.withColumn("text", F.when(F.rand(1) < 0.1, "three words more").otherwise(F.col("text")))
    sized = mixing.sized_documents(odd)
    _, table = mixing.prepare(sized)
    known = mixing.staged(mixing.with_source(sized, table, ["source_no", "source_size", "target"]))
    one = mixing.lay_out(known, N + 40, chunk_rows=10 * N).select("doc_id", "source_no", "size", "start")
    laid = mixing.lay_out(known, N + 40, chunk_rows=500)
    assert sorted(laid.columns) == sorted([*known.columns, "start"])
    many = laid.select("doc_id", "source_no", "size", "start")
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0
    # no window holds more than a few chunks of rows
    dealt = []
    window = mixing._laid_apart
    monkeypatch.setattr(mixing, "_laid_apart", lambda rows, chunk: dealt.append(rows.count()) or window(rows, chunk))
    mixing.lay_out(known, N + 40, chunk_rows=500)
    assert dealt == [N]


def test_columns_named_like_the_helpers(spark, tmp_path):
    rows = [(i, f"word {i} and some more words to read {i % 7}", "en", "ab"[i % 2]) for i in range(60)] + [(None, "no id", None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("_mix_key", "_mix_row_key", "_mix_times", "_mix_copy", "key", "times", "copy", "_kept", "_set", "_row", "_digest",
                 "_place_of", "_shard", "_slot", "slot", "of", "c0", "c1", "h", "norm", "bucket", "state", "lines", "roll", "g"):
        df = df.withColumn(name, F.lit(name))
    for helper in (mixing.repeated_documents, shingle_join.keep_one_each, exact_dedup.deduplicate, linededup.deduplicate):
        got = helper(df)
        assert got.columns == df.columns
        kept = got.select(*df.columns[4:]).distinct().collect()
        assert [tuple(r) for r in kept] == [tuple(df.columns[4:])]
    unique = df.where("doc_id IS NOT NULL")
    sharding.write_shards(unique, str(tmp_path / "shards"), 4)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.drop("shard").exceptAll(unique).count() == 0 and back.count() == 60
    with pytest.raises(ValueError):
        sharding.write_shards(unique.withColumnRenamed("key", "Shard"), str(tmp_path / "no"), 4)


def test_components_that_leave_the_numbers(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1e307, 0.0]), (2, [-1e307, 1.0]), (3, [float("nan"), 1.0]), (4, [3.0, 1.0])],
                               "vec_id long, embedding array<double>")
    got = topk.top_k(df, F.col("id") == 0, k=5).collect()
    assert [(r.query_id, r.vec_id) for r in got] == [(0, 4)]
