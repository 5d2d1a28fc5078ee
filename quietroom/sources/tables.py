"""Reading messages and lists, writing offences."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..schemas import MESSAGE, RULE_TABLES
from .storage import staged

#: Offences of a day that one file holds.
ROWS_PER_FILE = 100_000


def typed(df: DataFrame, ddl: str, mapping: dict[str, str] | None = None) -> DataFrame:
    """Project to a fixed schema; ``mapping`` gives SQL expressions for renamed columns.
    Columns that are neither present nor mapped become null."""
    mapping = mapping or {}
    fields = StructType.fromDDL(ddl).fields

    def one(f) -> Column:
        if f.name in mapping:
            c = F.expr(mapping[f.name])
        elif f.name in df.columns:
            c = F.col(f.name)
        else:
            c = F.lit(None)
        return c.cast(f.dataType).alias(f.name)

    return df.select(*[one(f) for f in fields])


def spread(df: DataFrame, each: int = 1) -> DataFrame:
    """Use all cores for text work when the input comes in fewer pieces than there are cores.

    Large inputs already have more splits than cores and are left as they are.  Long work may ask for
    more pieces for ``each`` core, as a few more pieces than cores keep some cores waiting for the last.
    """
    pieces = each * df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(pieces) if df.rdd.getNumPartitions() < pieces else df


def read_messages(spark: SparkSession, path: str, fmt: str = "parquet",
                  mapping: dict[str, str] | None = None) -> DataFrame:
    """Typed message table from parquet or JSON files; only mapped columns are scanned."""
    reader = spark.read.format(fmt)
    if fmt == "json" and mapping is None:
        reader = reader.schema(MESSAGE)
    return typed(reader.load(path), MESSAGE, mapping)


def read_message_stream(spark: SparkSession, path: str, schema: str | StructType = MESSAGE,
                        start: str = "latest", fmt: str = "parquet",
                        mapping: dict[str, str] | None = None,
                        files_per_batch: int = 64, **options) -> DataFrame:
    """New and edited messages as they arrive.

    ``start="latest"`` drops the backlog, as a moderator coming back online does: for Kafka
    by offsets, for files by taking only files newer than now.
    """
    reader = spark.readStream.format(fmt).options(**options)
    if fmt == "kafka":
        body = (reader.option("startingOffsets", start).load()
                .select(F.from_json(F.col("value").cast("string"), schema).alias("m")))
        return typed(body.select("m.*"), MESSAGE, mapping)
    reader = reader.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if start == "latest":
        now = spark.sql("SELECT date_format(now(), \"yyyy-MM-dd'T'HH:mm:ss\") AS t").first()["t"]
        reader = reader.option("modifiedAfter", now)
    return typed(reader.load(path), MESSAGE, mapping)


def read_rules(spark: SparkSession, folder: str, fmt: str = "parquet",
               optional: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """The list and member tables under ``folder``.

    A table that is not there is an error, as a lost block list would go unnoticed; those named
    in ``optional`` are then empty.
    """
    out = {}
    for name, ddl in RULE_TABLES.items():
        try:
            out[name] = typed(spark.read.format(fmt).load(f"{folder}/{name}"), ddl)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND" or name not in optional:
                raise
            out[name] = spark.createDataFrame([], ddl)
    return out


def write_offences(rows: DataFrame, path: str, mode: str = "append", files_per_day: int = 4) -> None:
    """Append offence rows, one folder per day (UTC), however many tasks found them.

    A day has one file, as each takes some time of its own, and up to ``files_per_day`` only where it
    has more than ``ROWS_PER_FILE`` rows: days are counted first, and few have so many.
    """
    day = F.date_from_unix_date(F.floor(F.col("ts_s") / 86400).cast("int"))
    rows = staged(rows.withColumn("date", day))
    files = F.least(F.ceil(F.col("count") / ROWS_PER_FILE), F.lit(files_per_day))
    large = rows.groupBy("date").count().where(F.col("count") > ROWS_PER_FILE).select(
        F.col("date").alias("_day"), files.alias("_files"))
    dealt = rows.join(large, F.col("date").eqNullSafe(F.col("_day")), "left")
    part = F.pmod(F.xxhash64("chat_id", "user_id", "ts_s", "message_id"), F.coalesce("_files", F.lit(1)))
    (dealt.withColumn("_part", part).repartition("date", "_part").drop("_day", "_files", "_part")
     .write.mode(mode).partitionBy("date").parquet(path))


def read_offences(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
