"""The work-list of pictures to decode, kept up over a stream of messages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .live import PROVIDER, ROCKSDB, start_batches


def new_pictures(msgs: DataFrame) -> DataFrame:
    """Pictures of a message stream (``image``, as ``pick_rendition`` gives it), each the first time its
    key is seen.  The keys seen are state, without an end, as old pictures are sent again at any time;
    a key costs its own length there, and any later message with it is dropped before the decoder."""
    msgs.sparkSession.conf.set(PROVIDER, ROCKSDB)
    keys = msgs.select(F.col("image.unique_id").alias("unique_id"), F.col("image.file_id").alias("file_id"))
    return keys.filter("unique_id IS NOT NULL").dropDuplicates(["unique_id"])


def start_picture_queue(msgs: DataFrame, read_decoded: Callable[[], DataFrame], path: str, checkpoint: str,
                        available_now: bool = False):
    """Queue every picture once, unless it is decoded (``unique_id``) when its batch begins.

    ``read_decoded`` is called per batch, so results that came in since take effect; to go on from
    a queue that was made in batch (``undecoded_images``), let it return those keys too.
    """

    def todo(batch: DataFrame, batch_id: int) -> DataFrame:
        return batch.join(read_decoded().select("unique_id").distinct(), "unique_id", "left_anti")

    return start_batches(new_pictures(msgs), todo, path, checkpoint, available_now)
