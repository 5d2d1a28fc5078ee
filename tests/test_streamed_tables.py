"""Tables that are folders of files, read as streams."""

import pytest

from quietroom.checks import QUERIES, state_checks


@pytest.fixture(scope="module", params=["folder", "file"])
def tables(spark, request, tmp_path_factory):
    docs = spark.range(24).selectExpr(
        "id AS doc_id", "concat('words of text ', id) AS text", "'en' AS lang", "'web' AS source",
        "CAST(20 AS BIGINT) AS n_chars")
    pages = spark.range(10).selectExpr(
        "id AS page_id", "concat('https://', if(id % 2 = 0, 'docs', 'no'), '.example.org/x') AS url", "'' AS html")
    events = spark.range(30).selectExpr(
        "id AS event_id", "id % 4 AS user_id", "timestamp_seconds(1704067200 + id) AS ts",
        "element_at(array('signup', 'error', 'view'), CAST(id % 3 + 1 AS INT)) AS event_type",
        "CAST(id AS DOUBLE) AS value", "'' AS props")
    folder = str(tmp_path_factory.mktemp("tables"))
    for name, df in (("documents", docs), ("pages", pages), ("events", events)):
        if request.param == "folder":
            df.repartition(3).write.parquet(f"{folder}/{name}.parquet")
        else:
            df.toPandas().to_parquet(f"{folder}/{name}.parquet", coerce_timestamps="us")
    spark.range(1).write.parquet(f"{folder}/documents.parquet.old")  # another table of a like name
    return folder


def test_message_stream(spark, tables):
    got = QUERIES["read_message_stream"](spark, tables).collect()
    assert sorted((r.message_id, r.chat_id, r.text) for r in got) == [
        (i, 1 + i % 5, f"words of text {i}") for i in range(24)]


def test_rule_refresh(spark, tables):
    got = QUERIES["stream_rule_refresh"](spark, tables).collect()
    assert sorted((r.page_id, r.listed) for r in got) == [(i, i % 2 == 0) for i in range(10)]


def test_event_streams(spark, tables):
    got = QUERIES["stream_offence_sink"](spark, tables).collect()
    assert sorted(r.id for r in got) == [i for i in range(30) if i % 3]
    assert QUERIES["dedupe_edits"](spark, tables).count() == len({(i % 4, i % 3) for i in range(30)})


def test_scored_folder(spark, tables, monkeypatch):
    """What stream_verdicts and read_history go on from: messages, edits, joins and offences."""
    monkeypatch.setattr(state_checks, "attach", lambda spark, sf_dir: lambda features: features)
    rows = spark.read.parquet(state_checks.scored_folder(spark, tables))
    kinds = {r.is_msg: r["count"] for r in rows.groupBy("is_msg").count().collect()}
    assert kinds == {1: 24 + 4, 0: 10, 2: 20}
