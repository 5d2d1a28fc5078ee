"""List tables on files that are edited in place: an edit writes only the buckets of keys it changes.

Under ``path`` lie ``data/<edit>/bucket=<n>`` with the rows, and ``versions/<n>``, one small text a
version, which names the folder of every bucket.  A version appears by one rename that fails if the
number is taken, so readers see a table before or after an edit, and of two edits at once
one fails and can be tried again.  Folders that no version in use names may be removed.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.lists import apply_list_changes
from .storage import staged

BUCKET = "bucket"


def _hadoop(spark: SparkSession, path: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, at, at.getFileSystem(conf), conf


def _latest(spark: SparkSession, path: str) -> int:
    _, at, files, _ = _hadoop(spark, f"{path}/versions")
    if not files.exists(at):
        return -1
    names = [s.getPath().getName() for s in files.listStatus(at)]
    return max((int(n) for n in names if n.isdigit()), default=-1)


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict]:
    version = _latest(spark, path) if version is None else version
    if version < 0:
        raise FileNotFoundError(f"no table under {path}")
    text = spark.read.text(f"{path}/versions/{version}", wholetext=True).first()[0]
    return version, json.loads(text)


def _publish(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    jvm, hidden, files, conf = _hadoop(spark, f"{path}/versions/_writing-{uuid.uuid4().hex}")
    out = files.create(hidden, False)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    kinds = jvm.org.apache.hadoop.fs.Options.Rename
    keep = spark.sparkContext._gateway.new_array(kinds, 0)  # without OVERWRITE
    final = jvm.org.apache.hadoop.fs.Path(f"{path}/versions/{version}")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(hidden.toUri(), conf)
    context.rename(files.makeQualified(hidden), files.makeQualified(final), keep)


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _write_buckets(rows: DataFrame, path: str) -> dict[str, str]:
    """Write rows that carry their bucket; the folder of each bucket with rows."""
    folder = f"data/{uuid.uuid4().hex}"
    rows.repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{path}/{folder}")
    _, at, files, _ = _hadoop(rows.sparkSession, f"{path}/{folder}")
    names = [s.getPath().getName() for s in files.listStatus(at) if s.isDirectory()]
    return {n.split("=")[1]: f"{folder}/{n}" for n in names if n.startswith(f"{BUCKET}=")}


def _read(spark: SparkSession, path: str, manifest: dict, chosen: set[str] | None = None) -> DataFrame:
    schema = StructType.fromJson(manifest["schema"])
    folders = [f for b, f in sorted(manifest["folders"].items()) if chosen is None or b in chosen]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{path}/{f}" for f in folders])


def create_list(table: DataFrame, path: str, keys: list[str], buckets: int = 64) -> None:
    """Write a table of one row per key as version 0.  Choose ``buckets`` so that one of them is
    a file of handy size: it is the least an edit writes."""
    if BUCKET in table.columns:
        raise ValueError(f"a list table cannot have a column {BUCKET}")
    folders = _write_buckets(table.withColumn(BUCKET, _bucket(keys, buckets)), path)
    _publish(table.sparkSession, path, 0, {
        "keys": keys, "buckets": buckets, "schema": json.loads(table.schema.json()), "folders": folders})


def read_list(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table in its latest version, or in an earlier one."""
    return _read(spark, path, _manifest(spark, path, version)[1])


def edit_list(spark: SparkSession, path: str, changes: DataFrame, kept: tuple[str, ...] = ()) -> int:
    """Apply ordered edits as ``apply_list_changes`` does; returns the version that holds them.

    Only buckets with edited keys are read, only those whose rows come out different are written,
    and all others keep their files.  Edits that change nothing, such as those of a run that is
    repeated, leave the version as it was.
    """
    version, manifest = _manifest(spark, path)
    keys, schema = manifest["keys"], StructType.fromJson(manifest["schema"])
    typed = changes.select("op", "seq", *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])
    changes = staged(typed.withColumn(BUCKET, _bucket(keys, manifest["buckets"])))
    touched = {str(r[0]) for r in changes.select(BUCKET).distinct().collect()}  # at most all buckets
    old = _read(spark, path, manifest, touched)
    new = staged(apply_list_changes(old, changes.drop(BUCKET), keys, kept).select(*schema.names))
    both = old.exceptAll(new).unionByName(new.exceptAll(old))
    changed = {str(r[0]) for r in both.select(_bucket(keys, manifest["buckets"])).distinct().collect()}
    if not changed:
        return version
    rows = new.withColumn(BUCKET, _bucket(keys, manifest["buckets"]))
    written = _write_buckets(rows.filter(F.col(BUCKET).isin(*map(int, changed))), path)
    folders = {b: f for b, f in manifest["folders"].items() if b not in changed} | written
    _publish(spark, path, version + 1, {**manifest, "folders": folders})
    return version + 1
