"""The brake fed back on a stream, history handed over, pictures to decode, lists edited on files."""

from pyspark.sql import functions as F

from ..operators import images as I
from ..operators import state as T
from ..sources.editable import create_list, edit_list, read_list
from ..sources.storage import new_folder, staged
from ..streaming import brake as B
from ..streaming import handover as H
from ..streaming import live
from ..streaming import pictures as P
from .base import ORACLE, query, with_views
from .list_checks import member_edits
from .rule_checks import CFG, prepared
from .state_checks import (CAP, REPLAY, REPLAY_SOURCES, USERS_AND_CHANNELS, WHOLE_BATCH, brake_resets, decoded,
                           past_offences, pictures, scored_both, scored_folder, with_edits)
from .views import load


def _stream_of(df, files, order, **options):
    """A table as a stream of some files, each holding a range of a column."""
    folder = new_folder(df.sparkSession, "feed")
    df.repartitionByRange(files, order).write.parquet(folder)
    return df.sparkSession.readStream.schema(df.schema).options(**options).parquet(folder)


@query("stream_apply_brake", ORACLE["apply_brake"])
def _stream_apply_brake(spark, sf_dir):
    o = load(spark, sf_dir, "offences").select("id", "ts_s", "action")
    resets = brake_resets(spark, sf_dir).select("id", "ts_s", F.lit(B.RESET).alias("action"))
    beat = o.agg(F.lit(None).cast("bigint").alias("id"), (F.max("ts_s") + T.DAY).alias("ts_s"),
                 F.lit(None).cast("string").alias("action"))
    feed = _stream_of(o.unionByName(resets).unionByName(beat), 4, "ts_s").withColumn(
        "ts", F.timestamp_seconds("ts_s"))
    path = new_folder(spark, "brakes")
    live.start_offence_sink(B.stream_brakes(feed, 5, 3600), path, new_folder(spark, "cp"), True).awaitTermination()
    return B.actions_in_force(o, B.read_brakes(spark, path))


# --- history handed over --------------------------------------------------------------------


@query("stream_after_batch", with_views(USERS_AND_CHANNELS, *REPLAY_SOURCES, more=REPLAY, recursive=True))
def _stream_after_batch(spark, sf_dir):
    scored = staged(scored_both(spark, sf_dir, with_edits(prepared(spark, sf_dir))))
    joins, past = load(spark, sf_dir, "joins"), past_offences(spark, sf_dir)
    cut = F.lit(scored.agg(F.floor(F.percentile_approx("ts_s", 0.5))).first()[0])
    early, late = F.col("ts_s") < cut, F.col("ts_s") >= cut
    found = staged(T.replay_verdicts(scored.filter(early), joins.filter(early), CFG, offences=past.filter(early)))
    history = staged(H.history_after(scored.filter(early), joins.filter(early), found, offences=past.filter(early)))
    rows = live.stream_rows(scored.filter(late), joins.filter(late), past.filter(late))
    feed = new_folder(spark, "scored")
    live.write_batch(rows, feed, 0)
    path = new_folder(spark, "live")
    out = live.stream_verdicts(live.read_scored(spark, feed, WHOLE_BATCH), CFG, history)
    live.start_offence_sink(out, path, new_folder(spark, "sink"), True).awaitTermination()
    columns = "message_id", "ts_s", "offender_id", "is_new", "prior_offences"
    return found.select(*columns, F.col("verdict.score").cast("bigint").alias("score")).unionByName(
        spark.read.parquet(path).withColumnRenamed("user_id", "offender_id").select(*columns, "score"))


_HISTORY = with_views("SELECT chat_id, user_id, first_seen, cnt AS msg_count, n AS offences FROM fold "
                      "QUALIFY row_number() OVER (PARTITION BY chat_id, user_id ORDER BY rn DESC) = 1",
                      *REPLAY_SOURCES, more=REPLAY, recursive=True)


@query("history_after", _HISTORY)
def _history_after(spark, sf_dir):
    scored = staged(scored_both(spark, sf_dir, with_edits(prepared(spark, sf_dir))))
    joins, past = load(spark, sf_dir, "joins"), past_offences(spark, sf_dir)
    found = staged(T.replay_verdicts(scored, joins, CFG, offences=past))
    return H.history_after(scored, joins, found, offences=past).select(*H.HISTORY)


@query("read_history", _HISTORY)
def _read_history(spark, sf_dir):
    checkpoint = new_folder(spark, "sink")
    out = live.stream_verdicts(live.read_scored(spark, scored_folder(spark, sf_dir), WHOLE_BATCH), CFG)
    live.start_offence_sink(out, new_folder(spark, "live"), checkpoint, True).awaitTermination()
    return H.read_history(spark, checkpoint)


# --- pictures, lists on files ---------------------------------------------------------------


@query("stream_undecoded_images", ORACLE["undecoded_images"])
def _stream_undecoded(spark, sf_dir):
    m = I.pick_rendition(pictures(spark, sf_dir), CAP).select("message_id", "image")
    known = decoded(spark, sf_dir).filter("has_qr")
    path = new_folder(spark, "queue")
    P.start_picture_queue(_stream_of(m, 4, "message_id", maxFilesPerTrigger=1), lambda: known, path,
                          new_folder(spark, "cp"), True).awaitTermination()
    return spark.read.parquet(path).select("unique_id")


@query("edit_list", ORACLE["upsert_list_entry"])
def _edit_list(spark, sf_dir):
    members, changes = member_edits(spark, sf_dir)
    path = new_folder(spark, "members")
    create_list(members, path, ["chat_id", "user_id"], 8)
    edit_list(spark, path, changes, ("first_seen",))
    return read_list(spark, path)
