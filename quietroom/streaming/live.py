"""Moderation of a stream of messages.

Two queries share a folder.  The first scores each micro-batch with the lists as they are at
that moment and leaves the texts behind; the second keeps the senders' history as state and
emits offences.  Both restart from their checkpoints, and everything written is addressed by
batch, so a repeated batch is written once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..config import FORCED_SCORE, ModerationConfig
from ..operators.scoring import total
from ..sources.shipping import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

SCORED = """message_id bigint, chat_id bigint, user_id bigint, by_channel boolean, ts_s bigint, is_msg int,
points_new int, points_old int, why_new string, why_old string, forced_reason string,
action string"""
OFFENCES = """message_id bigint, chat_id bigint, user_id bigint, by_channel boolean, ts_s bigint, is_new boolean,
prior_offences bigint, score bigint, threshold bigint, reasons string, mode string"""
STATE = "first_seen bigint, msg_count bigint, offences bigint"


JOIN, MESSAGE, LOGGED = 0, 1, 2  # kinds of rows; at equal times they count in this order


def stream_rows(scored: DataFrame, joins: DataFrame | None = None,
                offences: DataFrame | None = None) -> DataFrame:
    """Scored messages (joins, offences logged elsewhere) in the narrow form the second query reads.

    A message sent as a channel carries the channel as its sender; channels have no history.
    """

    def why(sig):
        return F.array_join(F.transform(sig, lambda s: F.concat(
            s["reason"], F.lit(" (+"), s["points"].cast("string"), F.lit(")"))), "; ")

    channel = F.col("sender_chat_id")
    rows = scored.select(
        "message_id", "chat_id", F.coalesce(channel, F.col("user_id")).alias("user_id"),
        channel.isNotNull().alias("by_channel"), "ts_s", F.lit(MESSAGE).alias("is_msg"),
        total(F.col("signals_new")).alias("points_new"),
        total(F.col("signals_old")).alias("points_old"),
        why("signals_new").alias("why_new"), why("signals_old").alias("why_old"),
        "forced_reason", "action")
    if joins is not None:
        rows = rows.unionByName(joins.select(
            F.col("id").alias("message_id"), "chat_id", "user_id", F.lit(False).alias("by_channel"), "ts_s",
            F.lit(JOIN).alias("is_msg")), allowMissingColumns=True)
    if offences is not None:
        rows = rows.unionByName(offences.select(
            F.col("id").alias("message_id"), "chat_id", "user_id", F.lit(False).alias("by_channel"), "ts_s",
            F.lit(LOGGED).alias("is_msg")), allowMissingColumns=True)
    return rows


def write_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write one micro-batch under its own folder, unless that was done before.

    The rows go to a hidden folder, which readers pass over, and appear under their final name
    by one rename.  A batch that Spark runs again finds that name taken and changes nothing, so
    a query that reads the folder never sees a row twice.
    """
    jvm, conf = rows.sparkSession._jvm, rows.sparkSession._jsc.hadoopConfiguration()
    final = jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch_id}")
    files = final.getFileSystem(conf)
    if files.exists(final):
        return
    hidden = f"{path}/_writing-{batch_id}-{uuid.uuid4().hex}"
    rows.write.parquet(hidden)
    if not files.rename(jvm.org.apache.hadoop.fs.Path(hidden), final):
        raise RuntimeError(f"batch {batch_id} could not be moved to its place")


def start_batches(stream: DataFrame, each: Callable[[DataFrame, int], DataFrame], path: str,
                  checkpoint: str, available_now: bool = False):
    """Run ``each`` on every micro-batch and store its result.

    ``each`` is called anew per batch, so lists it reads take effect with the next batch.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        write_batch(each(batch, batch_id), path, batch_id)

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(
        processingTime="10 seconds")
    return writer.start()


def refresh_rules(read: Callable[[], dict[str, DataFrame]],
                  score: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
                  ) -> Callable[[DataFrame, int], DataFrame]:
    """An ``each`` for ``start_batches`` that reads the lists again for every batch."""
    return lambda batch, batch_id: score(batch, read())


class SenderHistory(StatefulProcessor):
    """State of one sender in one chat: first seen, message count, offences."""

    def __init__(self, cfg: ModerationConfig):
        self.window = cfg.new_member_seconds
        self.messages = cfg.new_member_messages
        self.limits = {new: cfg.threshold_for(new) for new in (True, False)}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("history", STATE)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        seen = None if pd.isna(row.first_seen) else int(row.first_seen)
        self.state.update((seen, int(row.msg_count), int(row.offences)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        # a key's rows of one micro-batch; its size is bounded by the files per trigger
        batch = pd.concat(list(rows)).sort_values(["ts_s", "is_msg", "message_id"], ignore_index=True)
        if key[2]:
            yield self._offences(batch, key, self._channel(batch))
            return
        state = self.state.get() if self.state.exists() else (None, 0, 0)
        hits, state = self._member(batch, *state)
        self.state.update(state)
        yield self._offences(batch, key, hits)

    def _channel(self, batch: pd.DataFrame) -> list[tuple]:
        points = batch["points_old"].fillna(0).to_numpy()
        sure = batch["forced_reason"].notna().to_numpy() | (points >= self.limits[False])
        return [(i, False, 0) for i in np.flatnonzero(sure)]

    def _member(self, batch: pd.DataFrame, seen, count, offences):
        """Offences of a member as (row, was new, offences before), and the state afterwards.

        Counting is done for the whole batch; only rows that could be an offence of somebody
        with a record are looked at one by one.
        """
        ts, kind = batch["ts_s"].to_numpy(), batch["is_msg"].to_numpy()
        upto, logged = np.cumsum(kind == MESSAGE), np.cumsum(kind == LOGGED)
        new_points, old_points = (batch[c].fillna(0).to_numpy() for c in ("points_new", "points_old"))
        forced = batch["forced_reason"].notna().to_numpy()
        bans = (batch["action"] == "ban").to_numpy()

        def reach(points, limit):
            return points + np.where(points > 0, 4, 0) >= limit

        def sight(row):
            """Time at which the member is seen, from a row on."""
            rest = np.flatnonzero(kind[row:] != LOGGED)
            return int(ts[row + rest[0]]) if len(rest) else None

        maybe = (kind == MESSAGE) & (
            forced | reach(new_points, self.limits[True]) | reach(old_points, self.limits[False]))
        seen = sight(0) if seen is None else int(seen)
        start, hits = 0, []  # counted messages before the current spell; rows that are offences
        for i in np.flatnonzero(maybe):
            number = count + upto[i] - start
            new = bool(ts[i] - seen < self.window or number <= self.messages)
            points = new_points[i] if new else old_points[i]
            before = int(offences + len(hits) + logged[i])
            extra = min(2 * before, 4) if points > 0 else 0
            if not forced[i] and points + extra < self.limits[new]:
                continue
            hits.append((i, new, before))
            if bans[i]:
                count, start = 0, upto[i]
                seen = sight(i + 1)
        return hits, (seen, int(count + upto[-1] - start), int(offences + len(hits) + logged[-1]))

    def _offences(self, batch: pd.DataFrame, key, hits: list[tuple]) -> pd.DataFrame:
        out = []
        for i, new, before in hits:
            r = batch.iloc[i]
            if isinstance(r.forced_reason, str):
                score, limit, why = FORCED_SCORE, 1, r.forced_reason
            else:
                points = int(r.points_new if new else r.points_old)
                extra = min(2 * before, 4) if points > 0 else 0
                score, limit, why = points + extra, self.limits[new], r.why_new if new else r.why_old
                if extra:
                    why = f"{why}; prior_offences: {before} (+{extra})"
            out.append((r.message_id, *key, r.ts_s, new, before, score, limit, why, r.action))
        names = [c.split()[0] for c in OFFENCES.replace("\n", " ").split(", ")]
        return pd.DataFrame(out, columns=names)

    def close(self) -> None:
        pass


def stream_verdicts(rows: DataFrame, cfg: ModerationConfig,
                    initial: DataFrame | None = None) -> DataFrame:
    """Offences from a stream of ``stream_rows``; ``initial`` seeds the senders' history with
    ``chat_id, user_id, first_seen, msg_count, offences``."""
    rows.sparkSession.conf.set(PROVIDER, ROCKSDB)
    ship(rows.sparkSession)
    keys = ["chat_id", "user_id", "by_channel"]
    keyed = rows.groupBy(*keys)
    seed = initial.withColumn("by_channel", F.lit(False)).groupBy(*keys) if initial is not None else None
    return keyed.transformWithStateInPandas(
        SenderHistory(cfg), OFFENCES, outputMode="Append", timeMode="None", initialState=seed)


def read_scored(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    return (spark.readStream.schema(SCORED).option("maxFilesPerTrigger", files_per_batch)
            .parquet(f"{path}/batch=*"))


def start_offence_sink(offences: DataFrame, path: str, checkpoint: str,
                       available_now: bool = False):
    """Append offences as they happen; each batch is written exactly once."""
    return start_batches(offences, lambda batch, batch_id: batch, path, checkpoint, available_now)


def dedupe_edits(stream: DataFrame, within: str = "1 day") -> DataFrame:
    """Optional: scan each edit of a message once even if it is delivered again.

    Off by default, as an edited message counts as a new one.  Needs ``ts timestamp``,
    ``message_id`` and ``edited_s``.
    """
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(
        ["message_id", "edited_s"])
