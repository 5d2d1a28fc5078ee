import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from quietroom.config import ModerationConfig
from quietroom.operators import state as T
from quietroom.sources import editable as ED
from quietroom.sources.storage import new_folder
from quietroom.streaming import brake as B
from quietroom.streaming import handover as H
from quietroom.streaming import live
from quietroom.streaming import pictures as P
from tests.test_state import CFG, DDL, by_hand, random_log

VERDICTS = "id bigint, ts_s bigint, action string"


def fed(spark, schema, batches):
    """A stream that takes one batch a trigger, in order."""
    folder = new_folder(spark, "feed")
    for i, rows in enumerate(batches):
        live.write_batch(spark.createDataFrame(rows, schema).coalesce(1), folder, i)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/batch=*")
    return stream.withColumn("ts", F.timestamp_seconds("ts_s")) if "ts_s" in stream.columns else stream


def drained(spark, stream):
    path = new_folder(spark, "out")
    live.start_offence_sink(stream, path, new_folder(spark, "cp"), True).awaitTermination()
    return spark.read.parquet(path).drop("batch")


@pytest.mark.parametrize("seed", [4, 5])
def test_live_brake_equals_batch_brake(spark, seed):
    rnd = random.Random(seed)
    rows = [(i, t, rnd.choice(["ban", "ban", "mute", "delete"]))
            for i, t in enumerate(sorted(rnd.randint(0, 3000) for _ in range(400)))]
    resets = [(i, rnd.randint(0, 3000), B.RESET) for i in range(25)]
    every = sorted(rows + resets, key=lambda r: r[1])
    cuts = [0, 90, 91, 230, 330, len(every)]  # seconds are cut between batches, too
    batches = [every[a:b] for a, b in zip(cuts, cuts[1:])] + [[(None, 10_000, None)]]
    log = drained(spark, B.stream_brakes(fed(spark, VERDICTS, batches), 4, 60, late="5 seconds"))
    df = spark.createDataFrame(rows, VERDICTS)
    cfg = ModerationConfig(brake_limit=4, brake_window=60)
    want = T.apply_brake(df, spark.createDataFrame(resets, VERDICTS), cfg)
    got = B.actions_in_force(df, log)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert log.filter("braked").count() > 3 and log.filter("NOT braked").count() > 2


def test_ring_without_feedback(spark):
    rows = [(i, t, "ban") for i, t in enumerate([0, 0, 60, 61, 121, 500])]
    batches = [rows[:3], rows[3:], [(None, 9000, None)]]
    got = drained(spark, B.stream_ban_brake(fed(spark, VERDICTS, batches), 2, 60, late="1 second"))
    assert sorted(map(tuple, got.collect())) == [(0, 2), (60, 3), (61, 2), (121, 2)]


def test_tail_needs_a_heartbeat(spark):
    rows = [[(i, 100, "ban") for i in range(5)]]
    assert drained(spark, B.stream_brakes(fed(spark, VERDICTS, rows), 4, 60)).count() == 0
    rows.append([(None, 300, None)])
    got = drained(spark, B.stream_brakes(fed(spark, VERDICTS, rows), 4, 60)).collect()
    assert [tuple(r) for r in got] == [(100, 4, 4, True)]
    with pytest.raises(ValueError):
        B.stream_brakes(fed(spark, VERDICTS, rows), 0, 60)


def test_brake_switches_the_next_batch(spark):
    log = new_folder(spark, "brakes")
    first = [(i, 100 + i, "ban") for i in range(5)]
    later = [(9, 300, "ban"), (10, 400, "delete"), (11, 600, "mute")]
    path, cp, feed = new_folder(spark, "acted"), new_folder(spark, "cp"), new_folder(spark, "feed")

    def act(rows, batch):
        live.write_batch(spark.createDataFrame(rows, VERDICTS), feed, batch)
        stream = spark.readStream.schema(VERDICTS).parquet(f"{feed}/batch=*")
        B.start_braked_sink(stream, log, path, cp, True).awaitTermination()

    act(first, 0)  # nothing is known yet
    beats = [[(None, 200, None)], [(1, 500, B.RESET)], [(None, 900, None)]]
    brakes = drained(spark, B.stream_brakes(fed(spark, VERDICTS, [first, *beats]), 3, 60))
    live.write_batch(brakes, log, 0)
    act(later, 1)
    got = {r.id: r.effective_action for r in spark.read.parquet(path).collect()}
    assert got == {0: "ban", 1: "ban", 2: "ban", 3: "ban", 4: "ban", 9: "report", 10: "report", 11: "mute"}


# --- history ------------------------------------------------------------------------------

MEMBERS = "chat_id bigint, user_id bigint, first_seen bigint, msg_count bigint, trusted boolean"
LOGGED = "id bigint, chat_id bigint, user_id bigint, ts_s bigint"


@pytest.mark.parametrize("seed", [21, 22])
def test_half_batch_half_stream(spark, seed):
    rows, joins = random_log(seed, 400)
    known = {(1, 2): (1_699_000_000, 9), (2, 3): (1_699_900_000, 1), (2, 77): (5, 5)}
    cut = rows[len(rows) // 2][4]
    scored, j = spark.createDataFrame(rows, DDL), spark.createDataFrame(joins, LOGGED)
    past = spark.createDataFrame([(1, 1, 3, 1_700_000_500)], LOGGED)
    members = spark.createDataFrame([(*k, *v, k[0] == 1) for k, v in known.items()], MEMBERS)
    want = by_hand(rows, joins, [(1, 3, 1_700_000_500)], known)

    early = F.col("ts_s") < cut
    found = T.replay_verdicts(scored.filter(early), j.filter(early), CFG, members, past)
    history = H.history_after(scored.filter(early), j.filter(early), found, members, past)
    assert history.filter("first_seen IS NULL").count() + history.filter("offences > 1").count() > 2
    feed, out, cp = (new_folder(spark, n) for n in ("scored", "out", "cp"))
    live.write_batch(live.stream_rows(scored.filter(~early), j.filter(~early)), feed, 0)
    stream = live.stream_verdicts(live.read_scored(spark, feed), CFG, history)
    live.start_offence_sink(stream, out, cp, True).awaitTermination()
    columns = "message_id", "offender_id", "is_new", "prior_offences", "score"
    got = found.withColumn("score", F.col("verdict.score")).select(*columns).collect() + spark.read.parquet(
        out).withColumnRenamed("user_id", "offender_id").select(*columns).collect()
    assert sorted(map(tuple, got)) == want

    # what the stream holds in the end equals what a batch over everything ends with
    whole = T.replay_verdicts(scored, j, CFG, members, past)
    end = sorted(map(tuple, H.history_after(scored, j, whole, members, past).select(*H.HISTORY).collect()), key=repr)
    assert sorted(map(tuple, H.read_history(spark, cp).collect()), key=repr) == end


def test_members_after(spark):
    members = spark.createDataFrame([(1, 1, 10, 4, True), (1, 2, 10, 4, True), (1, 3, 10, 4, True),
                                     (1, 4, 10, 4, None)], MEMBERS)
    history = spark.createDataFrame([(1, 1, 10, 7, 0), (1, 2, None, 0, 1), (1, 3, 90, 1, 1), (1, 5, 50, 2, 0)],
                                    "chat_id bigint, user_id bigint, first_seen bigint, msg_count bigint, offences bigint")
    got = sorted(map(tuple, H.members_after(members, history).collect()))
    assert got == [(1, 1, 10, 7, True), (1, 3, 90, 1, False), (1, 4, 10, 4, False), (1, 5, 50, 2, False)]


def test_history_of_nobody(spark):
    found = T.replay_verdicts(spark.createDataFrame([], DDL), None, CFG)
    assert H.history_after(spark.createDataFrame([], DDL), None, found).count() == 0


# --- pictures -----------------------------------------------------------------------------


def test_pictures_are_queued_once(spark):
    schema = "message_id bigint, image struct<file_id:string,unique_id:string>"
    batches = [[(1, ("f1", "a")), (2, ("f2", "a")), (3, None), (4, ("f4", "b"))],
               [(5, ("f5", "a")), (6, ("f6", "c")), (7, ("f7", "d")), (8, ("f8", None))],
               [(9, ("f9", "d")), (10, ("f0", "c"))]]
    calls = []

    def decoded():  # b is known from the start, d comes in after the first batch
        calls.append(1)
        return spark.createDataFrame([("b",)] + [("d",)] * (len(calls) > 1), "unique_id string")

    path = new_folder(spark, "queue")
    P.start_picture_queue(fed(spark, schema, batches), decoded, path, new_folder(spark, "cp"),
                          True).awaitTermination()
    got = [(r.unique_id, r.file_id) for r in spark.read.parquet(path).collect()]
    assert sorted(u for u, _ in got) == ["a", "c"] and dict(got)["c"] == "f6"


# --- lists on files -----------------------------------------------------------------------

EDITS = "op string, seq bigint, k int, v string, t int"


def test_an_edit_writes_only_its_buckets(spark):
    path = new_folder(spark, "list")
    ED.create_list(spark.createDataFrame([(i, f"v{i}", i) for i in range(200)], "k int, v string, t int"), path,
                   ["k"], 16)
    before = ED._manifest(spark, path)[1]["folders"]
    edits = spark.createDataFrame([("set", 1, 3, "x", 0), ("delete", 2, 5, None, None), ("add", 3, 900, "n", 1),
                                   ("add", 4, 7, "not this", 1)], EDITS)
    assert ED.edit_list(spark, path, edits, ("t",)) == 1
    after = ED._manifest(spark, path)[1]["folders"]
    assert 1 <= sum(before[b] != after[b] for b in before) <= 3  # 7 was there already
    want = {i: (f"v{i}", i) for i in range(200) if i != 5} | {3: ("x", 3), 900: ("n", 1)}
    assert {r.k: (r.v, r.t) for r in ED.read_list(spark, path).collect()} == want
    assert ED.edit_list(spark, path, edits, ("t",)) == 1  # once more: nothing to do
    assert ED._manifest(spark, path)[1]["folders"] == after
    assert ED.read_list(spark, path, 0).count() == 200


def test_buckets_run_empty_and_fill_again(spark):
    path = new_folder(spark, "list")
    ED.create_list(spark.createDataFrame([], "k int, v string"), path, ["k"], 4)
    assert ED.read_list(spark, path).count() == 0
    one = [("add", 1, 1, "a", None)]
    assert ED.edit_list(spark, path, spark.createDataFrame(one, EDITS)) == 1
    gone = spark.createDataFrame([("delete", 1, 1, None, None)], EDITS)
    assert ED.edit_list(spark, path, gone) == 2
    assert ED.read_list(spark, path).count() == 0 and ED._manifest(spark, path)[1]["folders"] == {}
    assert ED.edit_list(spark, path, gone) == 2
    with pytest.raises(FileNotFoundError):
        ED.read_list(spark, new_folder(spark, "none"))
    with pytest.raises(ValueError):
        ED.create_list(spark.createDataFrame([(1,)], "bucket int"), path, ["bucket"])


def test_of_two_edits_at_once_one_fails(spark):
    path = new_folder(spark, "list")
    ED.create_list(spark.createDataFrame([(1, "a")], "k int, v string"), path, ["k"], 4)
    manifest = ED._manifest(spark, path)[1]
    ED._publish(spark, path, 1, manifest)
    with pytest.raises(Py4JJavaError, match="FileAlreadyExists|exist"):
        ED._publish(spark, path, 1, {})
    assert ED.read_list(spark, path).count() == 1
