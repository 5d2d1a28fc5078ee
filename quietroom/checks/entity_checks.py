"""Links, mentions, phones and the other entities."""

from pyspark.sql import functions as F

from ..functions import entities as E
from .base import AFTER, BEFORE, joined, messages, query, with_views
from .views import load, table

# --- fixed values, in the other engine's pattern dialect -----------------------------------
URL_SQL = (BEFORE + r"((?i:(?:https?://|www\.)?(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+(?:"
           + E.LINK_TLDS + r"))\b(?:/\S*)?)")
PHONE_SQL = (r"(?:^|[^\d+])(0[35789]\d(?:[\s.\-]?\d){7})(?:$|\D)"
             r"|(\+\d{1,3}[\s.\-]?\d(?:[\s.\-]?\d){5,13})(?:$|\D)")
CRYPTO_SQL = (r"\b(bc1|[13])[a-hj-np-z0-9]{25,62}\b|\b0x[a-fA-F0-9]{40}\b"
              r"|\bT[1-9A-HJ-NP-Za-km-z]{33}\b")
SPELLED_SQL = (BEFORE + r"(?i:[a-z0-9][a-z0-9-]{1,61}\s*[(\[{]?\s*(?:dot|\.|,)\s*[)\]}]?\s*"
               r"(?:com|net|org|io|xyz|top|vip|win|club|shop|live|me))" + AFTER)
INVITE_SQL = r"(?i)t\.me/\+|t\.me/joinchat/|telegram\.me/\+|telegram\.dog/"
MONEY_SQL = (BEFORE + r"(?i:\d{2,4}\s*(?:k|m|usd))" + AFTER
             + "|" + BEFORE + r"\d{2,4}\s*\$[\p{L}\p{N}_]"
             + "|" + BEFORE + r"(?i:\d{1,4}\s*(?:tr|trieu|triệu|củ|cu))" + AFTER
             + r"|[$₫]\s*\d{3,}")
EMOJI_SQL = r"[^\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}\x{1F1E6}-\x{1F1FF}\x{2B00}-\x{2BFF}]"
# ------------------------------------------------------------------------------------------
BODY_SQL = "concat_ws(' ', nullif(text, ''), nullif(caption, ''))"
SCAN_SQL = f"trim(concat_ws(' ', {BODY_SQL}, qr_payload, ocr_text))"


def urls_sql(x):
    return f"list_distinct(regexp_extract_all({x}, '{URL_SQL}', 1))"


def host_sql(u):
    return f"regexp_extract({u}, '(?i)^(?:[a-z][a-z0-9+.-]*://)?(?:www\\.)?([^/?#:]+)', 1)"


def path_sql(u):
    return (f"trim(lower(regexp_extract({u}, "
            "'^(?:[a-z][a-z0-9+.-]*://)?[^/]*/([^?#]*)', 1)), '/')")


def mentions_sql(x):
    pattern = r"(?:^|[^\p{L}\p{N}_@/])@([A-Za-z][A-Za-z0-9_]{4,31})\b"
    return f"list_distinct(list_transform(regexp_extract_all({x}, '{pattern}', 1), " \
           "lambda h: lower(h)))"


def phones_sql(x):
    both = (f"list_concat(regexp_extract_all({x}, '{PHONE_SQL}', 1), "
            f"regexp_extract_all({x}, '{PHONE_SQL}', 2))")
    return (f"list_distinct(list_filter(list_transform({both}, "
            r"lambda p: regexp_replace(p, '[\s.\-]', '', 'g')), lambda p: p <> ''))")


def text_of(xs):
    return f"array_to_string(list_sort({xs}), '|')"


def _on_messages(name, column, expr, sql, where="", spark_where=None):
    def run(spark, sf_dir):
        m = messages(spark, sf_dir)
        if spark_where is not None:
            m = m.filter(spark_where)
        return m.select("message_id", expr().alias(column))
    query(name, with_views(f"SELECT message_id, {sql} AS {column} FROM messages {where}",
                           "messages"))(run)


body = lambda: E.message_text("text", "caption")
scannable = lambda: E.scannable_text(body(), "qr_payloads", "ocr_text")

_on_messages("message_text", "body", body, BODY_SQL)
_on_messages("scannable_text", "body", scannable, SCAN_SQL)
_on_messages("extract_urls", "urls", lambda: joined(E.extract_urls("text")),
             text_of(urls_sql("text")))
_on_messages("extract_mentions", "handles", lambda: joined(E.extract_mentions("text")),
             text_of(mentions_sql("text")))
_on_messages("extract_phones", "phones", lambda: joined(E.extract_phones(scannable())),
             text_of(phones_sql(SCAN_SQL)))
_on_messages("has_crypto_address", "found", lambda: E.has_crypto_address(scannable()),
             f"regexp_matches({SCAN_SQL}, '{CRYPTO_SQL}')")
_on_messages("has_money_amount", "found", lambda: E.has_money_amount("text"),
             f"regexp_matches(text, '{MONEY_SQL}')")
_on_messages("emoji_count", "emojis", lambda: E.emoji_count("text").cast("bigint"),
             f"length(regexp_replace(text, '{EMOJI_SQL}', '', 'g'))")
_on_messages("has_obfuscated_url", "found", lambda: E.has_obfuscated_url("text"),
             f"regexp_matches(text, '{SPELLED_SQL}')")
_on_messages("has_invite_link", "found", lambda: E.has_invite_link("text"),
             f"regexp_matches(text, '{INVITE_SQL}')")
_on_messages("forward_label", "label", lambda: E.forward_label("forward_origin"),
             "CASE forward_origin WHEN 'user' THEN 'người dùng' WHEN 'hidden_user' THEN "
             "'người dùng ẩn danh' WHEN 'chat' THEN 'nhóm khác' WHEN 'channel' THEN 'kênh khác' "
             "ELSE CASE WHEN forward_origin IS NOT NULL THEN 'nguồn khác' END END")
CAPS_SQL = (r"CASE WHEN length(regexp_replace(text, '\P{L}', '', 'g')) >= 25 THEN "
            r"round(length(regexp_replace(text, '\P{Lu}', '', 'g')) "
            r"/ length(regexp_replace(text, '\P{L}', '', 'g')), 6) END")
_on_messages("caps_ratio", "ratio", lambda: F.round(E.caps_ratio("text"), 6), CAPS_SQL)


@query("hostname", with_views(
    f"SELECT page_id, lower({host_sql('url')}) AS host FROM links", "links"))
def _hostname(spark, sf_dir):
    return load(spark, sf_dir, "links").select("page_id", E.hostname("url").alias("host"))


@query("split_url", with_views(
    f"SELECT page_id, lower({host_sql('url')}) AS host, {path_sql('url')} AS path FROM links",
    "links"))
def _split_url(spark, sf_dir):
    return load(spark, sf_dir, "links").select("page_id", E.split_url("url").alias("p")).select(
        "page_id", "p.host", "p.path")


@query("canonical_domain", with_views(
    "SELECT page_id, regexp_replace(regexp_extract(lower(concat('.', upper(url), '/')), "
    "'^\\.(?:https?://)?(?:www\\.)?([^?#]*)', 1), '/+$', '') AS entry FROM links", "links"))
def _canonical_domain(spark, sf_dir):
    raw = F.concat(F.lit(" ."), F.upper("url"), F.lit("/"))
    return load(spark, sf_dir, "links").select("page_id", E.canonical_domain(raw).alias("entry"))


@query("canonical_username",
       "SELECT c_custkey, lower(replace(c_name, '#', '_')) AS username FROM customer")
def _canonical_username(spark, sf_dir):
    raw = F.concat(F.lit(" @"), F.translate("c_name", "#", "_"), F.lit(","))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", E.canonical_username(raw).alias("username"))


@query("canonical_phone",
       "SELECT c_custkey, concat('+84', lpad(CAST(c_custkey AS VARCHAR), 8, '0')) AS phone "
       "FROM customer")
def _canonical_phone(spark, sf_dir):
    n = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    raw = F.concat(F.lit(" (+84) "), n.substr(1, 3), F.lit("."), n.substr(4, 2), F.lit("-"),
                   n.substr(6, 3))
    return table(spark, sf_dir, "customer").select(
        "c_custkey", E.canonical_phone(raw).alias("phone"))


QR_SQL = rf"""CASE
  WHEN regexp_matches(qr_payload, '^000201(.|\n)*(5303\d{{3}}|58\d{{2}}[A-Z]{{2}})') THEN 'payment'
  WHEN regexp_matches(qr_payload, '(?i)^(bitcoin|ethereum|tron|litecoin|ton|solana|monero|bnb|metamask|trust|wc):')
    OR regexp_matches(qr_payload, '{CRYPTO_SQL}') THEN 'wallet'
  WHEN regexp_matches(qr_payload, '{INVITE_SQL}') OR regexp_matches(qr_payload, '(?i)^(tg|telegram)://')
    THEN 'invite'
  WHEN qr_payload LIKE 'http%' AND qr_payload NOT LIKE '%docs.example.org%' THEN 'unknown_link'
  WHEN qr_payload LIKE 'http%' THEN 'allowed_link' ELSE 'other' END"""


@query("classify_qr_payload", with_views(
    f"SELECT message_id, {QR_SQL} AS kind FROM messages WHERE qr_payload IS NOT NULL",
    "messages"))
def _classify(spark, sf_dir):
    allow = F.array(F.lit("docs.example.org"))
    return messages(spark, sf_dir).select("message_id", F.explode("qr_payloads").alias("p")).select(
        "message_id", E.classify_qr_payload("p", allow).alias("kind"))
