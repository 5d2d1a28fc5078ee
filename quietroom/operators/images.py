"""Picture metadata: which rendition to look at, and what was decoded from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ModerationConfig
from ..functions import entities as E
from ..sources.storage import staged

ENOUGH_PIXELS = 1280  # fixed value: a longer side than this adds nothing

RENDITION = "file_id:string,unique_id:string,file_size:bigint,width:int,height:int"


def _ref(r) -> Column:
    return F.struct(r["file_id"].alias("file_id"), r["unique_id"].alias("unique_id"),
                    r["file_size"].alias("file_size"))


def pick_rendition(msgs: DataFrame, max_bytes: int) -> DataFrame:
    """Add ``image``: the picture worth decoding as ``struct<file_id, unique_id, file_size>``, or
    null, and ``image_bytes``, its size.

    Columns ``photo`` (array of renditions), ``document`` and ``sticker`` (one rendition
    each, with ``mime_type`` and ``animated``).  Of the photo renditions within ``max_bytes``
    the smallest one that is sharp enough wins, else the largest.
    """
    usable = F.filter("photo", lambda p: F.coalesce(p["file_size"], F.lit(0)) <= max_bytes)
    w = lambda p: F.coalesce(p["width"], F.lit(0))
    h = lambda p: F.coalesce(p["height"], F.lit(0))
    sharp = F.filter(usable, lambda p: F.greatest(w(p), h(p)) >= ENOUGH_PIXELS)

    def by_area(items: Column, sign: int) -> Column:
        # first of equal areas, as the renditions come
        return F.transform(items, lambda p, i: F.struct(
            (sign * w(p).cast("bigint") * h(p)).alias("area"), i.alias("pos"), _ref(p).alias("ref")))

    best = F.when(F.size(sharp) > 0, F.array_min(by_area(sharp, 1))).otherwise(
        F.array_min(by_area(usable, -1)))

    def fits(c: str) -> Column:
        return F.coalesce(F.col(f"{c}.file_size"), F.lit(0)) <= max_bytes

    doc = F.col("document").isNotNull() & F.startswith(
        F.coalesce("document.mime_type", F.lit("")), F.lit("image/")) & fits("document")
    sticker = (F.col("sticker").isNotNull() & ~F.coalesce("sticker.animated", F.lit(False))
               & fits("sticker"))
    image = (F.when(F.size("photo") > 0, best["ref"]).when(doc, _ref(F.col("document")))
             .when(sticker, _ref(F.col("sticker"))))
    return msgs.withColumn("image", image).withColumn("image_bytes", F.col("image.file_size"))


def undecoded_images(msgs: DataFrame, signals: DataFrame) -> DataFrame:
    """Distinct picture keys that nobody has decoded yet."""
    keys = msgs.select(F.col("image.unique_id").alias("unique_id")).filter(
        "unique_id IS NOT NULL").distinct()
    return keys.join(signals.select("unique_id").distinct(), "unique_id", "left_anti")


def attach_image_signals(msgs: DataFrame, signals: DataFrame) -> DataFrame:
    """Give every message the result decoded once for its picture.

    Read texts may be long, so whether the results are broadcast is left to Spark, which knows
    the bytes of the written table.
    """
    decoded = staged(signals.select(F.col("unique_id").alias("_key"), "has_qr", "qr_payloads", "ocr_text"))
    joined = msgs.join(decoded, F.col("image.unique_id") == F.col("_key"), "left")
    return joined.select(*msgs.columns, F.coalesce("has_qr", F.lit(False)).alias("has_qr"),
                         F.coalesce("qr_payloads", E.no_strings()).alias("qr_payloads"),
                         F.coalesce("ocr_text", F.lit("")).alias("ocr_text"))


def image_gates(msgs: DataFrame, cfg: ModerationConfig) -> DataFrame:
    """Blank signals that the switches or the byte caps (``image_bytes``) would not yield."""
    qr = F.lit(cfg.scan_qr) & (F.col("image_bytes") <= cfg.qr_max_bytes)
    ocr = F.lit(cfg.scan_ocr) & (F.col("image_bytes") <= cfg.ocr_max_bytes)
    qr, ocr = F.coalesce(qr, F.lit(False)), F.coalesce(ocr, F.lit(False))
    return msgs.withColumns({
        "has_qr": F.col("has_qr") & qr,
        "qr_payloads": F.when(qr, F.col("qr_payloads")).otherwise(E.no_strings()),
        "ocr_text": F.when(ocr, F.col("ocr_text")).otherwise("")})
