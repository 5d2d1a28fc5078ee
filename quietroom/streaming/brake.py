"""The brake on ban bursts as a stream: its log of brakes and resets, and the actions they leave.

Verdicts are counted per second first, so the one state over all chats takes one row a second
however many messages there are.  Seconds are handed on when the watermark has passed them,
complete and in order.  Any row moves the watermark, so a stream at rest needs a heartbeat (a row
whose ``action`` is null) for its last seconds to be handed on.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.lists import broadcast_if_small
from ..operators.state import BANNING, as_of
from ..sources.shipping import ship
from ..sources.storage import staged
from .live import PROVIDER, ROCKSDB, start_batches

RESET = "reset"
BRAKES = "ts_s bigint, recent_bans bigint, kept bigint, braked boolean"


class BurstRing(StatefulProcessor):
    """Bans carried out in each of the last ``window`` seconds, and whether the brake is on.

    With ``feedback`` the brake, once on, keeps later bans from being carried out until a reset,
    and only its switching on and off is told; else every second at the limit is.
    """

    def __init__(self, limit: int, window: int, feedback: bool):
        self.limit, self.window, self.feedback = limit, window, feedback

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", "ts_s bigint, bans bigint")
        self.on = handle.getValueState("on", "braked boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):
        batch = pd.concat(list(rows)).sort_values("ts_s", ignore_index=True)
        ring = deque((int(t), int(n)) for t, n in self.ring.get()) if self.ring.exists() else deque()
        on = bool(self.on.get()[0]) if self.on.exists() else False
        recent, out = sum(n for _, n in ring), []
        seconds, counts, resets = (batch[c].tolist() for c in ("ts_s", "bans", "reset"))
        turns = [i for i, reset in enumerate(resets) if reset]
        at = 0
        while at < len(seconds):
            if on:  # nothing is carried out before the next reset
                turn = bisect_left(turns, at)
                if turn == len(turns):
                    break
                at = turns[turn]
            ts, kept = seconds[at], counts[at]
            recent -= self._expire(ring, ts)
            if on:
                on = False
                out.append((ts, recent, 0, False))
            if kept:
                if recent + kept >= self.limit:
                    if self.feedback:
                        # the ban that reaches the limit is the last one of its second to be carried out
                        on, kept = True, max(self.limit - recent, 1)
                    out.append((ts, recent + kept, kept, True))
                ring.append((ts, kept))
                recent += kept
            at += 1
        if seconds:
            self._expire(ring, seconds[-1])
        if ring:
            self.ring.put(list(ring))
        elif self.ring.exists():
            self.ring.clear()
        self.on.update((on,))
        yield pd.DataFrame(out, columns=["ts_s", "recent_bans", "kept", "braked"])

    def _expire(self, ring: deque, ts: int) -> int:
        """Take the seconds that have left the window off the ring; how many bans they held."""
        gone = 0
        while ring and ring[0][0] < ts - self.window:
            gone += ring.popleft()[1]
        return gone

    def close(self) -> None:
        pass


def _rings(verdicts: DataFrame, limit: int, window: int, late: str, feedback: bool) -> DataFrame:
    spark = verdicts.sparkSession
    spark.conf.set(PROVIDER, ROCKSDB)
    ship(spark)
    bans = F.count(F.when(F.col("action").isin(*BANNING), True))
    reset = F.coalesce(F.max(F.col("action") == RESET), F.lit(False))
    # only seconds with bans or resets become state.  The condition names the time, or it would be pushed below
    # the watermark and keep heartbeats from it
    counts = F.when(F.col("ts").isNotNull(), F.col("action").isin(*BANNING, RESET))
    seconds = (verdicts.withWatermark("ts", late).filter(counts).groupBy(F.window("ts", "1 second").alias("second"))
               .agg(bans.alias("bans"), reset.alias("reset")))
    rows = seconds.select(
        F.lit(0).alias("everywhere"), F.unix_seconds("second.start").alias("ts_s"), "bans", "reset")
    return rows.groupBy("everywhere").transformWithStateInPandas(
        BurstRing(limit, window, feedback), BRAKES, outputMode="Append", timeMode="None")


def stream_ban_brake(offences: DataFrame, limit: int, window: int, late: str = "1 minute") -> DataFrame:
    """Seconds at which the bans of the last ``window`` seconds reach ``limit``: ``ts_s, recent_bans``.

    ``offences`` needs ``ts timestamp`` and ``action``.
    """
    return _rings(offences, limit, window, late, feedback=False).select("ts_s", "recent_bans")


def stream_brakes(verdicts: DataFrame, limit: int, window: int, late: str = "1 minute") -> DataFrame:
    """The log of the brake: when it went on (``braked``, with the bans of that second still carried
    out in ``kept``) and when it was taken off.

    ``verdicts`` needs ``ts timestamp`` and ``action``; rows with the action ``reset`` are the moments
    at which an admin switched punishing back on, and come before the verdicts of their second.
    """
    if limit <= 0:
        raise ValueError("a brake without a limit never goes on")
    return _rings(verdicts, limit, window, late, feedback=True)


def read_brakes(spark: SparkSession, path: str) -> DataFrame:
    """The log as far as it has been written; empty before its first batch."""
    try:
        return spark.read.schema(BRAKES).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], BRAKES)


def actions_in_force(verdicts: DataFrame, brakes: DataFrame) -> DataFrame:
    """Add ``effective_action``: ``report`` wherever the log says that the brake was on.

    ``verdicts`` has ``id, ts_s, action``.  In the second in which the brake goes on, bans are
    carried out in the order of ``id`` up to the one that reached the limit, so a second should
    not be cut between two calls.
    """
    log = brakes.select("ts_s", F.col("braked").cast("bigint").alias("id"), F.struct(
        F.col("ts_s").alias("since"), "kept", "braked").alias("mark"))
    marked = staged(as_of(verdicts, staged(log), "mark", "_mark"))
    on = F.coalesce("_mark.braked", F.lit(False))
    same = on & (F.col("_mark.since") == F.col("ts_s"))
    rank = F.row_number().over(Window.partitionBy("ts_s").orderBy("id"))
    last = (marked.filter(same & F.col("action").isin(*BANNING)).withColumn("_rank", rank)
            .filter("_rank = _mark.kept").select(F.col("ts_s").alias("_since"), F.col("id").alias("_last")))
    out = marked.join(broadcast_if_small(staged(last)), F.col("_mark.since") == F.col("_since"), "left")
    stopped = on & ((F.col("ts_s") > F.col("_mark.since")) | F.coalesce(F.col("id") > F.col("_last"), F.lit(False)))
    return out.withColumn("effective_action", F.when(stopped, "report").otherwise(F.col("action"))).select(
        *verdicts.columns, "effective_action")


def start_braked_sink(verdicts: DataFrame, brakes_path: str, path: str, checkpoint: str,
                      available_now: bool = False):
    """Store verdicts with the action that the brake leaves them, by its log as it is when their
    batch begins: a brake found in one batch turns the actions of the next ones into ``report``."""
    return start_batches(verdicts, lambda batch, batch_id: actions_in_force(
        batch, read_brakes(batch.sparkSession, brakes_path)), path, checkpoint, available_now)
