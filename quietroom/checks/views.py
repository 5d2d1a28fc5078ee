"""Moderation inputs derived from the supplied tables.

The supplied tables hold prose, conversations and events, not chat logs.  Each view below
turns whole tables into the inputs the operators need, by one SELECT that both Spark and the
comparison engine run.  Texts are kept whole; a signal (a link, a phone number, look-alike
letters ...) is added to them by message number so that every rule has something to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

ZWSP = "​"
_UPPER = "'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
# Epoch seconds of an event without any time-zone arithmetic.
_EPOCH = {
    "spark": "(unix_date(CAST(ts AS DATE)) * 86400L + hour(ts) * 3600 + minute(ts) * 60"
             " + CAST(floor(second(ts)) AS INT))",
    "duckdb": "CAST(floor(epoch(ts)) AS BIGINT)",
}
_STRING = {"spark": "STRING", "duckdb": "VARCHAR"}

MESSAGES = f"""
SELECT doc_id AS message_id,
  CAST(1 + doc_id % 5 AS BIGINT) AS chat_id,
  CAST(1 + (doc_id * 7) % 37 AS BIGINT) AS user_id,
  CAST(1704067200 + doc_id * 997 AS BIGINT) AS ts_s,
  CASE doc_id % 20
    WHEN 0 THEN text
    WHEN 1 THEN concat(text, ' no news today')
    WHEN 2 THEN concat(text, ' see https://docs.example.org/en/guide for details')
    WHEN 3 THEN concat(text, ' visit http://promo-site.xyz/win?x=1 today')
    WHEN 4 THEN concat(text, ' short link tinyurl.com/abc123')
    WHEN 5 THEN concat(text, ' join t.me/+QuietRoomers now')
    WHEN 6 THEN concat(text, ' wallet 0x', repeat('c0ffee12ab', 4))
    WHEN 7 THEN concat(text, ' call 09', lpad(CAST(doc_id AS {{string}}), 8, '0'),
                       ' or +84 912 345 678')
    WHEN 8 THEN concat(text, ' ask @helper_one and @helper_two or @customer_',
                       lpad(CAST(doc_id AS {{string}}), 9, '0'))
    WHEN 9 THEN concat(text, ' vay tien nhanh, ho tro no xau')
    WHEN 10 THEN concat(text, ' Vay tiền nhanh, hỗ trợ nợ xấu')
    WHEN 11 THEN concat(text, ' passive income, join our vip, limited time')
    WHEN 12 THEN concat(text, ' v a y t i e n n h a n h')
    WHEN 13 THEN concat(text, ' ', repeat('🎁', 9))
    WHEN 14 THEN concat(text, ' earn 500k per day')
    WHEN 15 THEN concat(text, ' promo (dot) com')
    WHEN 16 THEN concat(text, ' is this group real?')
    WHEN 17 THEN concat(translate(text, 'aeo', 'аео'), ' pаssive incоme')
    WHEN 18 THEN concat(replace(text, 'th', 't{ZWSP}h'), ' pas{ZWSP}sive income')
    ELSE concat(translate(text, {_UPPER}), ' VERY LOUD MESSAGE FOR EVERYONE')
  END AS text,
  CASE WHEN doc_id % 10 = 3 THEN 'holiday photo' WHEN doc_id % 10 = 4 THEN '' END AS caption,
  doc_id % 11 = 0 AS is_forward,
  CASE doc_id % 55 WHEN 0 THEN 'user' WHEN 11 THEN 'hidden_user' WHEN 22 THEN 'chat'
    WHEN 33 THEN 'channel' WHEN 44 THEN 'story' END AS forward_origin,
  doc_id % 6 = 0 AS has_media,
  doc_id % 13 = 0 AS has_buttons,
  doc_id % 17 = 0 AS from_channel,
  doc_id % 4 <> 0 AS has_username,
  doc_id % 19 = 0 AS via_bot,
  doc_id % 23 = 0 AS has_story,
  doc_id % 20 IN (2, 3, 8) AS has_entities,
  CASE doc_id % 9 WHEN 0 THEN 'Trợ Lý Nhóm' WHEN 4 THEN 'ADMIN'
    ELSE concat('Member ', CAST(doc_id % 37 AS {{string}})) END AS sender_name,
  CASE WHEN doc_id % 4 <> 0 THEN concat('user_', CAST((doc_id * 7) % 37 AS {{string}}))
    END AS username,
  CASE WHEN doc_id % 17 <> 0 THEN CAST(NULL AS BIGINT)
    WHEN doc_id % 3 = 0 THEN CAST(1 + doc_id % 5 AS BIGINT)
    WHEN doc_id % 3 = 1 THEN CAST(-101 - doc_id % 5 AS BIGINT)
    ELSE CAST(-1000 - doc_id % 37 AS BIGINT) END AS sender_chat_id,
  CAST(-101 - doc_id % 5 AS BIGINT) AS linked_chat_id,
  doc_id % 29 = 0 AS is_automatic_forward,
  doc_id % 31 = 0 AS user_is_bot,
  doc_id % 18 = 0 AS has_qr,
  CASE doc_id % 108
    WHEN 0 THEN '000201010211320015BAKERYSTAND0042530397854047.506304BEEF'
    WHEN 18 THEN 'https://lucky-draw.example.biz/enter?table=7'
    WHEN 36 THEN concat('bitcoin:1', repeat('QuietRoom9', 3), '?amount=3')
    WHEN 54 THEN 'tg://join?invite=OpenKitchen'
    WHEN 72 THEN 'https://docs.example.org/en/guide'
    WHEN 90 THEN 'BEGIN:VCARD;FN:Reading Room;END:VCARD' END AS qr_payload,
  CASE WHEN doc_id % 24 = 0 THEN 'thu nhap thu dong, nhanh tay' ELSE '' END AS ocr_text,
  doc_id % 3 = 0 AS is_new_member,
  CAST(doc_id % 4 AS BIGINT) AS prior_offences
FROM {{documents}}
"""

OFFENCES = """
SELECT event_id AS id, CAST(1 + event_id % 5 AS BIGINT) AS chat_id, user_id,
  {epoch} AS ts_s, CAST(floor(value) AS BIGINT) AS score,
  CASE event_type WHEN 'error' THEN 'ban' WHEN 'purchase' THEN 'mute'
    WHEN 'click' THEN 'delete' ELSE 'report' END AS action,
  concat('rule_', CAST(event_id % 7 AS {string}), ' (+5)') AS reasons,
  props AS excerpt, concat('Member ', CAST(user_id AS {string})) AS name
FROM {events} WHERE event_type <> 'signup'
"""

JOINS = """
SELECT event_id AS id, CAST(1 + event_id % 5 AS BIGINT) AS chat_id,
  CAST(1 + user_id % 37 AS BIGINT) AS user_id, {epoch} AS ts_s
FROM {events} WHERE event_type = 'signup'
"""

VIEWS: dict[str, str] = {
    "messages": MESSAGES,
    "offences": OFFENCES,
    "joins": JOINS,
    # settings changed over time: the action in force and pauses
    "settings_log": """
SELECT event_id AS id, {epoch} AS ts_s,
  CASE WHEN event_id % 3 = 0 THEN 'pause_until' WHEN event_id % 3 = 1 THEN 'action'
    ELSE concat('cfg:', CASE event_id % 4 WHEN 0 THEN 'block_links' WHEN 1 THEN 'block_phones'
      WHEN 2 THEN 'scan_qr' ELSE 'block_forwards' END) END AS key,
  CASE WHEN event_id % 3 = 0 THEN CAST({epoch} + CAST(floor(value) AS BIGINT) * 60 AS {string})
    WHEN event_id % 3 = 1 THEN CASE event_id % 5 WHEN 0 THEN 'ban' WHEN 1 THEN 'mute'
      WHEN 2 THEN 'Delete ' WHEN 3 THEN 'report' ELSE '' END
    ELSE CASE event_id % 7 WHEN 0 THEN 'yes' WHEN 1 THEN '1' WHEN 2 THEN '1' ELSE '0' END
  END AS value
FROM {events} WHERE event_type = 'purchase'
""",
    "chat_whitelist": """
SELECT DISTINCT CAST(page_id % 6 AS BIGINT) AS chat_id,
  CASE WHEN page_id % 4 = 0 THEN split_part(split_part(url, '://', 2), '?', 1)
    ELSE split_part(split_part(url, '://', 2), '/', 1) END AS domain
FROM {pages} WHERE url LIKE '%.example.org/%'
UNION SELECT CAST(0 AS BIGINT), 'docs.example.org'
UNION SELECT CAST(1 AS BIGINT), 'example.com/en'
UNION SELECT CAST(0 AS BIGINT), 't.me/news'
""",
    "blacklist": """
SELECT DISTINCT CAST(event_id % 6 AS BIGINT) AS chat_id, CAST(1 + user_id % 37 AS BIGINT)
  AS entity_id FROM {events} WHERE event_type = 'error' AND value > 160
UNION SELECT CAST(2 AS BIGINT), CAST(-1005 AS BIGINT)
""",
    # entries put on the deny list and taken off it in the course of time
    "blacklist_log": """
SELECT event_id AS id, {epoch} AS ts_s, CAST(event_id % 6 AS BIGINT) AS chat_id,
  CAST(1 + user_id % 37 AS BIGINT) AS entity_id,
  CASE WHEN event_type = 'error' THEN 'add' ELSE 'delete' END AS op
FROM {events} WHERE event_type IN ('error', 'signup', 'purchase')
""",
    "forward_whitelist": """
SELECT DISTINCT CAST(event_id % 6 AS BIGINT) AS chat_id, CAST(1 + user_id % 37 AS BIGINT)
  AS user_id FROM {events} WHERE event_type = 'purchase' AND value > 180
""",
    "username_whitelist": """
SELECT CAST(c_nationkey % 6 AS BIGINT) AS chat_id, lower(replace(c_name, '#', '_')) AS username
FROM {customer} UNION SELECT CAST(0 AS BIGINT), 'helper_one'
""",
    "phone_whitelist": """
SELECT CAST(c_nationkey % 6 AS BIGINT) AS chat_id,
  concat('09', lpad(CAST(c_custkey AS {string}), 8, '0')) AS phone FROM {customer}
""",
    "keyword_blacklist": """
SELECT DISTINCT CAST(p_size % 6 AS BIGINT) AS chat_id, p_name AS phrase FROM {part}
UNION SELECT CAST(0 AS BIGINT), 'hỗ trợ nợ xấu'
UNION SELECT CAST(3 AS BIGINT), 'short link'
""",
    # long lists: phrases of two and of three words that stand in the texts themselves
    "text_phrases": """
SELECT DISTINCT CAST(doc_id % 6 AS BIGINT) AS chat_id,
  concat(split_part(text, ' ', 3), ' ', split_part(text, ' ', 4), ' ', split_part(text, ' ', 5)) AS phrase
FROM {documents} WHERE n_chars > 40
UNION SELECT DISTINCT CAST(doc_id % 7 AS BIGINT),
  concat(split_part(text, ' ', 8), ' ', split_part(text, ' ', 9)) FROM {documents} WHERE n_chars > 60
""",
    "presets": """
SELECT p_brand AS name, concat('Products of ', p_brand) AS label, p_partkey AS pos,
  p_name AS phrase FROM {part}
""",
    "admins": """
SELECT DISTINCT CAST(1 + s_nationkey % 5 AS BIGINT) AS chat_id,
  CAST(1 + s_suppkey % 37 AS BIGINT) AS user_id,
  concat('admin_', CAST(s_suppkey % 37 AS {string})) AS username
FROM {supplier} WHERE s_acctbal > 8000
""",
    "admin_status": """
SELECT CAST(1 + r_regionkey AS BIGINT) AS chat_id, r_name <> 'MIDDLE EAST' AS known FROM {region}
""",
    "bot_admins": """
SELECT CAST(1 + n_nationkey AS BIGINT) AS user_id FROM {nation} WHERE n_regionkey = 4
""",
    "managed_chats": """
SELECT CAST(1 + r_regionkey AS BIGINT) AS chat_id, r_name AS title FROM {region}
""",
    "members": """
SELECT CAST(1 + event_id % 5 AS BIGINT) AS chat_id, CAST(1 + user_id % 37 AS BIGINT) AS user_id,
  min({epoch}) AS first_seen, CAST(count(*) AS BIGINT) AS msg_count,
  max(value) > 190 AS trusted
FROM {events} WHERE event_type = 'view' GROUP BY 1, 2
""",
    "memberships": """
SELECT DISTINCT CAST(1 + event_id % 5 AS BIGINT) AS chat_id, user_id,
  CASE WHEN user_id % 10 = 0 THEN 'left' WHEN user_id % 10 = 1 THEN 'administrator'
    WHEN user_id % 10 = 2 THEN 'restricted' ELSE 'member' END AS status
FROM {events} WHERE event_type IN ('click', 'view')
""",
    "starters": """
SELECT c_custkey AS user_id, c_name AS name,
  CASE WHEN c_nationkey % 3 = 0 THEN '' ELSE lower(replace(c_name, '#', '_')) END AS username,
  CAST(1704067200 + c_custkey * 60 AS BIGINT) AS ts_s FROM {customer}
""",
    "image_renditions": """
SELECT doc_id AS message_id, concat('u', CAST(doc_id % 50 AS {string})) AS unique_id,
  CASE WHEN doc_id % 3 = 0 THEN 'photo' WHEN doc_id % 3 = 1 THEN 'document'
    ELSE 'sticker' END AS kind,
  n_chars * 1500 AS file_size, doc_id % 7 = 0 AS animated
FROM {documents}
""",
    "image_signals": """
SELECT concat('u', CAST(doc_id % 50 AS {string})) AS unique_id,
  min(doc_id) % 4 = 0 AS has_qr, concat('https://pay', CAST(min(doc_id) AS {string}),
  '.example.net/x') AS qr_payload, max(lang) AS ocr_text
FROM {documents} GROUP BY 1
""",
    "service_messages": """
SELECT event_id AS message_id, CAST(1 + event_id % 5 AS BIGINT) AS chat_id, {epoch} AS ts_s,
  CASE WHEN event_type = 'signup' THEN 'new_chat_members'
    WHEN event_type = 'error' THEN 'left_chat_member'
    WHEN event_id % 6 = 0 THEN 'pinned_message' WHEN event_id % 6 = 1 THEN 'new_chat_title'
    WHEN event_id % 6 = 2 THEN 'delete_chat_photo' WHEN event_id % 6 = 3 THEN 'video_chat_ended'
    WHEN event_id % 6 = 4 THEN 'forum_topic_edited' ELSE 'boost_added' END AS field
FROM {events}
""",
    "links": "SELECT page_id, url FROM {pages}",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "events", "documents", "pages",
          "labels", "conversations")


def view_sql(name: str, dialect: str) -> str:
    """The SELECT behind a view, reading base tables by name."""
    names = {t: t for t in TABLES} if dialect == "duckdb" else {t: "{" + t + "}" for t in TABLES}
    return VIEWS[name].format(epoch=_EPOCH[dialect], string=_STRING[dialect], **names)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the parquet tables in ``sf_dir``."""
    text = VIEWS[name]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
            for t in TABLES if "{" + t + "}" in text}
    return spark.sql(view_sql(name, "spark"), **used)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files, be it one file or a folder of them."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(stream_path(sf_dir, name))


def stream_path(sf_dir: str, name: str) -> str:
    """A pattern that only this table meets: a stream takes a single file by a pattern alone, and
    lists what is inside a folder."""
    return f"{sf_dir}/{name}.parque[t]"
