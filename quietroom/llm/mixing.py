"""Mixing sources to target weights by a low-discrepancy schedule of token blocks.

* The documents of a source, shuffled by a hash of their id, form a stream of words that
  repeats; it is cut into blocks of ``block_words`` words (the last of a round is shorter).
* Slot ``i`` of the schedule belongs to the source into whose part of [0, 1) the ``i``-th van
  der Corput point falls; parts are proportional to the number of blocks a source is to give.
  Every stretch of the schedule is therefore mixed like the whole.
* Slots are ranked per source, and the slot of rank ``r`` takes block ``r mod n`` of its source
  in round ``r div n``.  The last slot of a source takes only the words still missing, so that
  a source gives exactly ``floor(target)`` words.

Everything is DataFrame functions.  Positions and ranks are prefix sums in two levels (chunks,
then inside a chunk), so a source with most of the rows is spread over many tasks.  The driver
sees the number of sources, the total, and the scalars of the target computation.

Defined cases: a null text has no words; documents without words are never taken.  A null
source is a source (the last in order).  A null id sorts before the others.  Repeated rows are
documents of their own.  A source without a row in ``weights`` has weight 0 and gives nothing.
An empty table gives an empty mix.  Other columns take no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import log2_parts, numbered, staged, word_count

MAX_REPEATS = 3
BLOCK_WORDS = 1024
CHUNK_ROWS = 4_000
CHUNK_SLOTS = 1 << 16
SALTS = 16
SEED = "mix-1"


def source_sizes(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source").agg(F.sum("size").alias("source_size"))


def cyclic_weights(sources: DataFrame, cycle: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """(source, weight): sources in code-point order, null last, take the weights in turn."""
    placed = numbered(sources.select("source"), F.asc_nulls_last("source"), "place")
    values = F.array(*[F.lit(w) for w in cycle])
    return placed.select("source", F.element_at(
        values, (F.col("place") % len(cycle) + 1).cast("int")).cast("long").alias("weight"))


def targets(sources: DataFrame, weights: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, weight, target): shares of all words by weight, none above
    ``repeats`` times its source, the excess shared again by weight among the others.

    All shares rise with one level; it is raised until no further source reaches its limit.
    """
    weights = weights.select(F.col("source").alias("_w_source"), "weight")
    table = staged(sources.join(weights, F.col("source").eqNullSafe(F.col("_w_source")), "left")
                   .select("source", "source_size",
                           F.coalesce("weight", F.lit(0).cast("long")).alias("weight")))
    limit = F.col("source_size") * repeats
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        capped = (limit <= F.col("weight") * F.lit(level)) if full >= 0 else F.lit(False)
        n, words, open_weight = table.agg(
            F.count_if(capped), F.coalesce(F.sum(F.when(capped, limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0))).first()
        if n == full or not open_weight:
            break
        full, level = n, (total - words) / open_weight
    if full >= 0 and not open_weight:
        level = math.inf
    share = F.when(F.col("weight") > 0, F.col("weight") * F.lit(level)).otherwise(F.lit(0.0))
    return table.withColumn("target", F.least(limit.cast("double"), share))


def with_source(sized: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """Bring ``columns`` of the source table to each document.  Each source is present once
    per salt, so that the documents of a large one are dealt over several tasks."""
    salted = table.select(F.col("source").alias("_source"), *columns,
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt_of"))
    salt = F.pmod(F.xxhash64("doc_id", "size"), F.lit(SALTS)).cast("int")
    same = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_salt") == F.col("_salt_of"))
    return (sized.withColumn("_salt", salt).join(salted, same)
            .drop("_source", "_salt", "_salt_of"))


def _before(df: DataFrame, keys: list[str], chunk: str, value: Column, name: str) -> DataFrame:
    """Per (keys, chunk): what earlier chunks of the keys sum up to."""
    sums = df.groupBy(*keys, chunk).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*keys, chunk, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias(name))


def lay_out(sized: DataFrame, rows: int, seed: str = SEED, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Add ``start``: where a document begins in the shuffled stream of its source."""
    text = F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    at = F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")
    bits = log2_parts(rows, chunk_rows)
    placed = sized.withColumn("_at", at).withColumn("_chunk", F.shiftright("_at", 60 - bits))
    # an id that very many rows of a source share (null, say) stands as one row first
    shared = staged(placed.groupBy("source_no", "_at").agg(
        F.count(F.lit(1)).alias("_rows"), F.sum("size").alias("size"), F.first("_chunk").alias("_chunk"))
        .where(F.col("_rows") > chunk_rows).drop("_rows"))
    if shared.isEmpty():
        return _laid(placed).drop("_at", "_chunk")
    keys = F.broadcast(shared.select("source_no", "_at"))  # at most rows / chunk_rows
    alone = placed.join(keys, ["source_no", "_at"], "left_anti")
    both = _laid(alone.withColumn("_shared", F.lit(False)).unionByName(
        shared.withColumn("_shared", F.lit(True)), allowMissingColumns=True))
    firsts = F.broadcast(staged(both.where("_shared").select("source_no", "_at", F.col("start").alias("_group"))))
    return both.where("NOT _shared").drop("_at", "_chunk", "_shared").unionByName(
        _laid_apart(placed.drop("_chunk").join(firsts, ["source_no", "_at"]), chunk_rows))


def _laid(placed: DataFrame) -> DataFrame:
    """Add ``start`` by place, id and size, one window for each chunk of a source."""
    before = _before(placed, ["source_no"], "_chunk", F.col("size"), "_first")
    inside = (Window.partitionBy("source_no", "_chunk")
              .orderBy("_at", F.asc_nulls_first("doc_id"), "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    return (placed.join(before, ["source_no", "_chunk"])
            .withColumn("start", F.col("_first") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .drop("_first"))


def _laid_apart(rows: DataFrame, chunk_rows: int) -> DataFrame:
    """The same for the rows of shared ids, from ``_group`` on: by size, and those of one size, which are
    alike, dealt over as many parts as they need."""
    one = ["source_no", "_at", "size"]
    parts = rows.groupBy(*one).agg(F.ceil(F.count(F.lit(1)) / chunk_rows).alias("_parts"))
    dealt = staged(rows.join(F.broadcast(parts.where("_parts > 1")), one, "left").withColumn("_part", F.pmod(
        F.xxhash64(F.monotonically_increasing_id()), F.coalesce("_parts", F.lit(1)))).drop("_parts")
        .withColumn("_run", F.struct("size", "_part")))
    before = _before(dealt, ["source_no", "_at"], "_run", F.col("size"), "_first")
    inside = (Window.partitionBy(*one, "_part").orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, -1))
    return (dealt.join(before, ["source_no", "_at", "_run"])
            .withColumn("start", F.col("_group") + F.col("_first") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
            .drop("_at", "_run", "_part", "_first", "_group"))


def _radical_inverse(i: Column, bits: int) -> Column:
    """Van der Corput point of ``i``: its binary digits mirrored behind the point."""
    mirrored = F.conv(F.reverse(F.lpad(F.bin(i), bits, "0")), 2, 10).cast("long")
    return mirrored / F.lit(float(1 << bits))


def schedule(table: DataFrame, sources: int, spark_partitions: int | None = None) -> DataFrame:
    """(slot, source_no, rank) for a table (source_no, n_slots).

    A source whose part has length p gets at least p·2^m - 2 of the first 2^m points, as each
    dyadic stretch is evenly filled; the number of points follows from the smallest n_slots, so
    that every source reaches its n_slots.  Points beyond are not used.
    """
    spark = table.sparkSession
    wanted = table.where("n_slots > 0")
    total, least = wanted.agg(F.sum("n_slots"), F.min("n_slots")).first()
    total, least = total or 0, least or 1
    bits = max(1, math.ceil(math.log2(total + math.ceil(2 * total / least) + 2)))
    cells = 1 << max(0, math.ceil(math.log2(max(1, 2 * sources))))
    ordered = numbered(wanted, F.asc("source_no"), "_place")
    upto = _before(ordered.withColumn("_chunk", F.floor(F.col("_place") / CHUNK_ROWS))
                   .withColumn("_one", F.lit(1)), ["_one"], "_chunk", F.col("n_slots"), "_first")
    inside = (Window.partitionBy("_chunk").orderBy("_place")
              .rowsBetween(Window.unboundedPreceding, 0))
    parts = (ordered.withColumn("_chunk", F.floor(F.col("_place") / CHUNK_ROWS))
             .join(upto.drop("_one"), "_chunk")
             .withColumn("hi", (F.col("_first") + F.sum("n_slots").over(inside)).cast("long"))
             .withColumn("lo", F.col("hi") - F.col("n_slots")))
    part_of = parts.select(
        "source_no", "n_slots", (F.col("lo") / total).alias("lo"), (F.col("hi") / total).alias("hi"))
    in_cells = part_of.withColumn("cell", F.explode(F.sequence(
        F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))))
    points = (spark.range(0, 1 << bits if total else 0, 1, spark_partitions)
              .select(F.col("id").alias("slot"), _radical_inverse(F.col("id"), bits).alias("u"))
              .withColumn("cell", F.floor(F.col("u") * cells)))
    owned = staged(points.join(in_cells, "cell").where("u >= lo AND u < hi")
                   .select("slot", "source_no", "n_slots",
                           F.floor(F.col("slot") / CHUNK_SLOTS).alias("_chunk")))
    before = _before(owned, ["source_no"], "_chunk", F.lit(1), "_first")
    here = F.row_number().over(Window.partitionBy("source_no", "_chunk").orderBy("slot"))
    return (owned.withColumn("_here", here).join(before, ["source_no", "_chunk"])
            .withColumn("rank", F.col("_first") + F.col("_here") - 1)
            .where("rank < n_slots").select("slot", "source_no", "rank"))


def sized_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    source_col: str = "source") -> DataFrame:
    return staged(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                              word_count(F.col(text_col)).alias("size")))


def prepare(sized: DataFrame, weights: DataFrame | None = None, repeats: int = MAX_REPEATS,
            seed: str = SEED) -> tuple[DataFrame, DataFrame]:
    """Laid-out documents and the source table with targets; ``weights`` default to 5, 2, 1."""
    sizes = staged(source_sizes(sized))
    weights = cyclic_weights(sizes) if weights is None else weights
    table = staged(numbered(targets(sizes, weights, repeats), F.asc_nulls_last("source"), "source_no"))
    known = with_source(sized, table, ["source_no", "source_size", "target"])
    return staged(lay_out(known, sized.count(), seed)), table


def mix(documents: DataFrame, table: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix, piece by piece: slot, source_no, rank, round, block, doc_id, start, size,
    first_word (inside the document), n_words.  In order of (slot, start) it is the mix."""
    words, length = F.floor("target").cast("long"), F.col("source_size")
    blocks = F.ceil(length / block_words)
    plan = staged(table.select(
        "source_no", words.alias("words"), length.alias("length"), blocks.alias("n_blocks"),
        F.when((words > 0) & (length > 0), F.expr("floor(target) div source_size") * blocks + F.ceil(
            F.pmod(words, length) / block_words)).otherwise(F.lit(0)).cast("long").alias("n_slots")))
    slots = schedule(plan.select("source_no", "n_slots"), table.count())
    slots = slots.join(plan, "source_no").select(
        "slot", "source_no", "rank", "words", "length",
        F.expr("rank div n_blocks").alias("round"), F.pmod("rank", "n_blocks").alias("block"))
    end = F.col("start") + F.col("size")
    pieces = documents.where("size > 0").select("source_no", "doc_id", "start", "size").withColumn(
        "block", F.explode(F.sequence(F.expr(f"start div {block_words}"),
                                      F.expr(f"(start + size - 1) div {block_words}"))))
    low = F.greatest(F.col("start"), F.col("block") * block_words)
    high = F.least(end, (F.col("block") + 1) * block_words,
                   F.col("words") - F.col("round") * F.col("length"))
    return (pieces.join(slots, ["source_no", "block"])
            .withColumn("first_word", low - F.col("start")).withColumn("n_words", high - low)
            .where("n_words > 0").drop("words", "length"))


def taken_words(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """Add ``taken`` to each laid-out document: its words in the mix, repeats counted."""
    got = pieces.groupBy("source_no", "start").agg(F.sum("n_words").alias("taken"))
    full = documents.where("size > 0").join(got, ["source_no", "start"], "left")
    none = documents.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return full.unionByName(none).withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def mixture(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id",
            text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS,
            repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, taken per document."""
    sized = sized_documents(docs, id_col, text_col, source_col)
    documents, table = prepare(sized, weights, repeats, seed)
    return taken_words(documents, mix(documents, table, block_words)).select(
        "doc_id", "source", "size", "source_size", "target", "taken")


def repeated_documents(docs: DataFrame, weights: DataFrame | None = None, id_col: str = "doc_id",
                       text_col: str = "text", source_col: str = "source", block_words: int = BLOCK_WORDS,
                       repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, all columns, as often as the mix takes them.

    Documents are whole here: one whose last round is cut is repeated as often as the number of
    words it gives comes nearest to.  Rows are told apart by id, source and size; rows that agree
    in all three share what the mix takes of them.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, names))

    def key(doc_id: Column, source: Column, size: Column) -> Column:
        known = [F.coalesce(c.cast("string"), F.lit("")) for c in (doc_id, source)]
        return F.concat_ws(":", doc_id.isNull().cast("string"), source.isNull().cast("string"), size.cast("string"), *known)

    taken = mixture(docs, weights, id_col, text_col, source_col, block_words, repeats, seed)
    copies = (taken.where("taken > 0").groupBy(key(F.col("doc_id"), F.col("source"), F.col("size")).alias("key"))
              .agg(F.floor(F.avg(F.col("taken") / F.col("size")) + 0.5).cast("int").alias("times")).where("times > 0"))
    rows = docs.toDF(*names).withColumn("key", key(F.col(at[id_col]), F.col(at[source_col]), word_count(F.col(at[text_col]))))
    met = rows.join(copies, "key").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    return met.select(*names).toDF(*docs.columns)
