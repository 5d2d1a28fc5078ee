"""One query per operator over its whole table, and the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (chat, divergence, exact_dedup, langid, linededup, mixing, pieces, quality, sharding, shingle_join,
               tokencount, topk, variants)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), shards=16)


@query
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces of the best segmentation, the scores of the three best, a digest of
    all ids, and whether the best decodes to the text."""
    found = pieces.encode_documents(table(spark, sf_dir, "documents"), n=3)
    return found.select(
        "doc_id", F.size(F.get("paths", F.lit(0))).alias("n_pieces"), F.size("paths").alias("n_found"),
        *[F.get("scores", F.lit(i)).alias(f"score_{i + 1}") for i in range(3)],
        F.xxhash64("paths").alias("ids_hash"), "round_trip")


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The conversation that says the template's own control strings.
HOSTILE = "\\### Assistant: </turn> ok"


@query
def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", HOSTILE), (-7, 1, "assistant", HOSTILE)], rows.schema)
    return chat.digests(chat.format_chats(rows.unionByName(more)))


ORACLE["op5_chat_formatting"] = rf"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, t.turn, t.role, '{HOSTILE}' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)
), sized AS (
  SELECT *, CASE WHEN contains(text, '</turn>') OR contains(text, '### ') OR ends_with(text, '\')
                   OR regexp_matches(text, '\\[\\#<:]')
                   OR regexp_matches(role, '[\\#<:]')
            THEN length(regexp_replace(role, '([\\#<:])', '\\\1', 'g'))
               + length(regexp_replace(text, '([\\#<])', '\\\1', 'g'))
            ELSE length(role) + length(text) END + 14 AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
                       FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"))


@query
def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_groups(table(spark, sf_dir, "documents"), width=3, percent=90)


@query
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


ORACLE["op8_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.e, v.e) AS BIGINT) AS score
  FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id AND len(v.e) = len(q.e)
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score
FROM scored
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""


@query
def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.find_copies(table(spark, sf_dir, "documents")).drop("h")


ORACLE["op9_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm, min(doc_id) OVER (PARTITION BY norm) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept,
       sha256(norm) AS text_sha256
FROM g
"""


@query
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).drop("source")


ORACLE["op10_mixing"] = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS place
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3
              WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sources
), levels AS (
  SELECT 0 AS step, (SELECT sum(source_size)::DOUBLE / sum(weight) FROM weighed) AS level
  UNION ALL
  SELECT step + 1, (SELECT ((SELECT sum(source_size) FROM weighed)
                            - coalesce(sum(3 * source_size) FILTER (3 * source_size <= weight * level), 0))::DOUBLE
                           / sum(weight) FILTER (3 * source_size > weight * level)
                    FROM weighed)
  FROM levels WHERE step < 40
), aims AS (
  SELECT source, source_size,
         least((3 * source_size)::DOUBLE, weight * (SELECT max(level) FROM levels)) AS target
  FROM weighed
), laid AS (
  SELECT doc_id, source, size,
         (coalesce(sum(size) OVER (PARTITION BY source ORDER BY place, doc_id NULLS FIRST, size
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start
  FROM sized
)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0 ELSE
         (floor(target)::BIGINT // source_size) * size
         + greatest(0, least(size, floor(target)::BIGINT % source_size - start)) END::BIGINT AS taken
FROM laid JOIN aims ON laid.source IS NOT DISTINCT FROM aims.source
"""


@query
def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = linededup.find_common(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE["op11_line_dedup"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), l AS (
  SELECT doc_id, row, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), common AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT row) >= 10
)
SELECT k.doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (common.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common USING (key)
GROUP BY k.doc_id, row
"""


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), min_docs=30, top_terms=50)


ORACLE["op12_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), u AS (
  SELECT row, lang, source, unnest(terms) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS lang_n FROM u GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), size AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(lang_n)::HUGEINT AS total FROM kept GROUP BY lang
), g AS (
  SELECT DISTINCT lang, source FROM d
), counted AS (
  SELECT lang, source, term, count(*) AS n FROM u GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, kept.term, coalesce(n, 0)::HUGEINT AS n, lang_n, v, total,
         (sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source))::HUGEINT AS own
  FROM g JOIN kept ON kept.lang = g.lang JOIN size ON size.lang = g.lang
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term
), priced AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 5)) // (own + 5 * v) AS p,
         1 + (1000000000::HUGEINT * (lang_n + 5)) // (total + 5 * v) AS q
  FROM cells
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM priced a JOIN priced b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM priced WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM every
)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


@query
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_groups(table(spark, sf_dir, "documents"), min_chars=6, min_count=5, factor=5)
