"""Senders' history handed from a batch replay to a stream, and from a stream back to the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lists import broadcast_if_small
from ..operators.state import KEY
from ..sources.storage import staged
from .live import PROVIDER, ROCKSDB

HISTORY = [*KEY, "first_seen", "msg_count", "offences"]


def history_after(msgs: DataFrame, joins: DataFrame | None, found: DataFrame,
                  members: DataFrame | None = None, offences: DataFrame | None = None) -> DataFrame:
    """Each sender's history after ``replay_verdicts`` over the same tables gave ``found``: what
    ``stream_verdicts`` takes as ``initial`` to go on from there.

    A ban makes the chat forget the sender, so only what follows the last one counts towards
    ``first_seen`` and ``msg_count``; a sender not seen since has null and 0.  The record
    (``offences``) stays.  Channels have no history.  One aggregation over all rows, combined before
    the shuffle; only the last bans, one row a sender, are joined.
    """
    users = found.filter("NOT by_channel").withColumnRenamed("offender_id", "user_id")
    last = users.filter("mode = 'ban'").groupBy(*KEY).agg(
        F.max(F.struct("ts_s", F.lit(1).alias("kind"), F.col("message_id").alias("id"))).alias("_ban"))
    last = broadcast_if_small(staged(last))
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")
    seen = msgs.filter("sender_chat_id IS NULL").select(
        *KEY, "ts_s", F.lit(1).alias("kind"), F.col("message_id").alias("id"), one.alias("n"))
    if joins is not None:
        seen = seen.unionByName(joins.select(*KEY, "ts_s", F.lit(0).alias("kind"), "id", none.alias("n")))
    if members is not None:
        # known since before the run
        seen = seen.unionByName(members.select(
            *KEY, F.col("first_seen").alias("ts_s"), F.lit(-1).alias("kind"), F.lit(None).cast("bigint").alias("id"),
            F.coalesce("msg_count", none).alias("n")))
    after = F.col("_ban").isNull() | ((F.col("kind") >= 0) & (F.struct("ts_s", "kind", "id") > F.col("_ban")))
    rows = seen.join(last, KEY, "left").select(
        *KEY, F.when(after & (F.col("kind") < 0), F.col("ts_s")).alias("known"),
        F.when(after, F.col("ts_s")).alias("ts_s"), F.when(after, F.col("n")).otherwise(none).alias("n"),
        none.alias("o"))
    for record in (users, offences):
        if record is not None:
            rows = rows.unionByName(record.select(*KEY, none.alias("n"), one.alias("o")), allowMissingColumns=True)
    return rows.groupBy(*KEY).agg(
        F.coalesce(F.min("known"), F.min("ts_s")).alias("first_seen"), F.sum("n").alias("msg_count"),
        F.sum("o").alias("offences"))


def read_history(spark: SparkSession, checkpoint: str) -> DataFrame:
    """The same out of the state that a stopped ``stream_verdicts`` query left in its checkpoint."""
    spark.conf.set(PROVIDER, ROCKSDB)
    state = spark.read.format("statestore").option("stateVarName", "history").load(checkpoint)
    return state.filter("NOT key.by_channel").select("key.chat_id", "key.user_id", "value.*").select(*HISTORY)


def members_after(members: DataFrame, history: DataFrame) -> DataFrame:
    """The members table as it stands after a run that left ``history``.

    Who was seen (again) stands in it with the new numbers, who was banned and not seen since is gone,
    and who did not write stays as before.  Trust ends with a ban, after which ``first_seen`` is another
    one.  The run must have begun with ``members``, or those it does not know count as banned.
    """
    now = history.select(*KEY, F.col("first_seen").alias("_seen"), F.col("msg_count").alias("_count"),
                         F.lit(True).alias("_ran"))
    both = members.join(now, KEY, "full_outer")
    gone = F.col("_ran") & F.col("_seen").isNull() & F.coalesce(F.col("_count") == 0, F.lit(True))
    return both.filter(~F.coalesce(gone, F.lit(False))).select(
        *KEY, F.coalesce("_seen", "first_seen").alias("first_seen"),
        F.coalesce("_count", "msg_count").alias("msg_count"),
        F.coalesce(F.col("trusted") & (F.coalesce("_seen", "first_seen") == F.col("first_seen")),
                   F.lit(False)).alias("trusted"))
