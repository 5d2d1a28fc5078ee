"""Small helpers that several operators share."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.storage import staged as _staged

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: White space in the sense of all contracts: blank, tab, line feed, VT, FF, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def staged(df: DataFrame) -> DataFrame:
    """Stage a table in the shared folder, and let Spark delete the shuffle files of the job
    when it is done, as a long chain of steps would otherwise keep the files of all of them."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP, "false")
    conf.set(_CLEANUP, "true")
    try:
        return _staged(df)
    finally:
        conf.set(_CLEANUP, before)


def discard(df: DataFrame) -> None:
    """Delete the files of a staged table that no later step reads."""
    for file in df.inputFiles()[:1]:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def held_out(doc_id: Column) -> Column:
    """True for the third of documents that no classifier may learn from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 != 1, F.lit(False))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def log2_parts(rows: int, each: int) -> int:
    """Bits of a key that cut ``rows`` evenly spread rows into parts of about ``each``."""
    return max(0, math.ceil(math.log2(max(1, rows) / each)))


def numbered(df: DataFrame, order: Column, name: str) -> DataFrame:
    """Number rows from 0 in a total order, without one task seeing all of them.

    The sorted table is staged with the place of each row inside its partition; only one
    count per partition meets in a window.
    """
    low = (1 << 33) - 1
    placed = staged(df.orderBy(order).select(
        "*", F.spark_partition_id().alias("_part"),
        F.monotonically_increasing_id().bitwiseAND(F.lit(low)).alias("_at")))
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    return (placed.join(firsts, "_part")
            .withColumn(name, F.col("_first") + F.col("_at")).drop("_part", "_at", "_first"))
