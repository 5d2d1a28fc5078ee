"""Lists, settings, presets, exemptions, sources and sinks."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ModerationConfig
from ..functions import entities as E
from ..operators import lists as L
from ..operators.state import exclude_paused, settings_as_of
from ..plans.reports import moderation_report, offence_rows
from ..schemas import RULE_TABLES
from ..sources import tables as S
from ..sources.storage import new_folder
from .base import joined, messages, query, sql_keep, sql_norm, with_views
from .entity_checks import mentions_sql, phones_sql
from .rule_checks import FEATURE_SOURCES, SCORE_VIEWS, lists_of, scored
from .views import load, table

CFG = ModerationConfig()


@query("read_messages", "SELECT doc_id AS message_id, 1 + doc_id % 5 AS chat_id, text, "
                        "lang AS sender_name FROM documents")
def _read_messages(spark, sf_dir):
    m = S.read_messages(spark, f"{sf_dir}/documents.parquet", mapping={
        "message_id": "doc_id", "chat_id": "1 + doc_id % 5", "sender_name": "lang"})
    return m.select("message_id", "chat_id", "text", "sender_name")


RULE_VIEWS = ("members", "chat_whitelist", "forward_whitelist", "blacklist",
              "username_whitelist", "phone_whitelist", "keyword_blacklist", "bot_admins",
              "starters")


def _columns(name):
    return [c.split()[0] for c in RULE_TABLES[name].split(",")]


def _rows_sql(name):
    shown = ", ".join(f"coalesce(CAST({c} AS VARCHAR), '-')" for c in _columns(name))
    return f"SELECT '{name}' AS name, concat_ws('|', {shown}) AS cells FROM {name}"


@query("read_rule_tables", with_views("\nUNION ALL ".join(map(_rows_sql, RULE_VIEWS)), *RULE_VIEWS))
def _read_rules(spark, sf_dir):
    folder = new_folder(spark, "rules")
    for n in RULE_VIEWS:
        S.typed(load(spark, sf_dir, n), RULE_TABLES[n]).write.parquet(f"{folder}/{n}")
    rules = S.read_rules(spark, folder)
    cells = [rules[n].select(F.lit(n).alias("name"), F.concat_ws("|", *[
        F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in _columns(n)]).alias("cells"))
        for n in RULE_VIEWS]
    return reduce(DataFrame.unionByName, cells)


# verdict rows of spam messages; the mode by chat, so that all actions appear
def _verdicts(spark, sf_dir):
    m = scored(spark, sf_dir).filter("verdict.is_spam").select("message_id", "verdict")
    mode = F.element_at(F.array(*[F.lit(a) for a in ("ban", "mute", "delete", "report", "ban")]),
                        F.col("chat_id").cast("int"))
    full = messages(spark, sf_dir).join(m, "message_id")
    return full.withColumns({
        "action": mode, "offender_id": L.sender_id(), "channel_title": F.lit(None).cast("string")})


_ACTION = "CASE m.chat_id WHEN 1 THEN 'ban' WHEN 2 THEN 'mute' WHEN 3 THEN 'delete' " \
          "WHEN 4 THEN 'report' ELSE 'ban' END"


@query("write_offences", with_views(f"""
SELECT m.chat_id, coalesce(sender_chat_id, user_id) AS user_id, ts_s, CAST(score AS BIGINT) AS score,
  {_ACTION} AS action, reasons, left(coalesce(nullif(text, ''), caption, ''), 400) AS excerpt,
  left(sender_name, 80) AS name, CAST(CAST(make_timestamp(ts_s * 1000000) AS DATE) AS VARCHAR) AS date
FROM scores JOIN messages m USING (message_id) WHERE score >= threshold""",
    *FEATURE_SOURCES, more=SCORE_VIEWS))
def _write_offences(spark, sf_dir):
    path = new_folder(spark, "offences")
    S.write_offences(offence_rows(_verdicts(spark, sf_dir)), path)
    back = S.read_offences(spark, path)
    return back.select("chat_id", "user_id", "ts_s", F.col("score").cast("bigint").alias("score"),
                       "action", "reasons", "excerpt", "name",
                       F.col("date").cast("string").alias("date"))


@query("moderation_report", with_views(f"""
SELECT message_id, m.chat_id, upper({_ACTION}) AS action,
  CASE WHEN username IS NULL THEN sender_name ELSE sender_name || ' (@' || username || ')' END AS who,
  coalesce(sender_chat_id, user_id) AS offender_id,
  regexp_replace(reasons, '\\s*\\(\\+\\d+\\)(; |$)', '\\1', 'g') AS why,
  left(text, 300) AS excerpt
FROM scores JOIN messages m USING (message_id) WHERE score >= threshold""",
    *FEATURE_SOURCES, more=SCORE_VIEWS))
def _report(spark, sf_dir):
    return moderation_report(_verdicts(spark, sf_dir))


# --- presets and edits -------------------------------------------------------------------

CHOSEN = ("Brand#7", "Brand#12", "Brand#3")
_CHOSEN = "name IN ('Brand#7', 'Brand#12', 'Brand#3')"


@query("load_preset", with_views(
    f"SELECT CAST(2 AS BIGINT) AS chat_id, phrase, EXISTS (SELECT 1 FROM keyword_blacklist k "
    f"WHERE k.chat_id = 2 AND k.phrase = p.phrase) AS already FROM presets p WHERE {_CHOSEN} "
    f"GROUP BY phrase", "presets", "keyword_blacklist"))
def _load_preset(spark, sf_dir):
    return L.load_preset(load(spark, sf_dir, "presets"), CHOSEN,
                         load(spark, sf_dir, "keyword_blacklist"), 2)


@query("unload_preset", with_views(
    f"SELECT chat_id, phrase FROM keyword_blacklist WHERE NOT (chat_id = 2 AND phrase IN "
    f"(SELECT phrase FROM presets WHERE {_CHOSEN}))", "presets", "keyword_blacklist"))
def _unload_preset(spark, sf_dir):
    return L.unload_preset(load(spark, sf_dir, "keyword_blacklist"),
                           load(spark, sf_dir, "presets"), CHOSEN, 2)


@query("upsert_list_entry", with_views("""
, log AS (SELECT CAST(event_id % 6 AS BIGINT) AS chat_id, 1 + user_id % 37 AS user_id,
  event_id AS seq, CASE event_type WHEN 'error' THEN 'delete' WHEN 'click' THEN 'set'
  ELSE 'add' END AS op, value > 100 AS trusted FROM events),
every AS (SELECT chat_id, user_id, -1 AS seq, 'add' AS op, first_seen, trusted FROM members
  UNION ALL SELECT chat_id, user_id, seq, op, seq AS first_seen, trusted FROM log),
live AS (SELECT * FROM every e WHERE op <> 'delete' AND NOT EXISTS (SELECT 1 FROM log d
  WHERE d.op = 'delete' AND d.chat_id = e.chat_id AND d.user_id = e.user_id AND d.seq > e.seq))
SELECT chat_id, user_id, arg_min(first_seen, seq) AS first_seen,
  coalesce(arg_max(trusted, seq) FILTER (op = 'set'), arg_min(trusted, seq)) AS trusted
FROM live GROUP BY 1, 2""".lstrip("\n"), "members").replace(")\n, log", "),\nlog"))
def _upsert(spark, sf_dir):
    return L.apply_list_changes(*member_edits(spark, sf_dir), ["chat_id", "user_id"], kept=("first_seen",))


def member_edits(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    op = (F.when(F.col("event_type") == "error", "delete")
          .when(F.col("event_type") == "click", "set").otherwise("add"))
    changes = e.select(
        (F.col("event_id") % 6).alias("chat_id"), (1 + F.col("user_id") % 37).alias("user_id"),
        op.alias("op"), F.col("event_id").alias("seq"), F.col("event_id").alias("first_seen"),
        (F.col("value") > 100).alias("trusted"))
    return load(spark, sf_dir, "members").select("chat_id", "user_id", "first_seen", "trusted"), changes


_SETTINGS_SQL = "latest AS (SELECT key, arg_max(value, (ts_s, id)) AS value FROM settings_log " \
                "GROUP BY 1)"


def _flag(name, default="true"):
    return (f"coalesce((SELECT CASE value WHEN '1' THEN true WHEN '0' THEN false END FROM latest "
            f"WHERE key = 'cfg:{name}'), {default}) AS {name}")


@query("effective_config", with_views(
    "SELECT coalesce((SELECT CASE WHEN lower(trim(value)) IN ('ban', 'mute', 'delete', 'report') "
    "THEN lower(trim(value)) END FROM latest WHERE key = 'action'), 'ban') AS action, "
    + ", ".join(_flag(n) for n in ("scan_ocr", "scan_qr", "ban_all_groups", "block_phones",
                                   "block_mentions", "block_fake_admin", "block_forwards",
                                   "block_links")), "settings_log", more=_SETTINGS_SQL))
def _effective_config(spark, sf_dir):
    return L.effective_config(L.latest_settings(load(spark, sf_dir, "settings_log")), CFG)


@query("effective_list", with_views(
    "SELECT DISTINCT c.chat_id, domain FROM managed_chats c JOIN chat_whitelist w "
    "ON w.chat_id IN (c.chat_id, 0)", "managed_chats", "chat_whitelist"))
def _effective_list(spark, sf_dir):
    return L.effective_list(load(spark, sf_dir, "chat_whitelist"),
                            load(spark, sf_dir, "managed_chats"), "domain")


def _eff(list_name, value, out):
    return (f"SELECT DISTINCT c.chat_id, '{out}' AS list, CAST({value} AS VARCHAR) AS value FROM "
            f"managed_chats c JOIN {list_name} w ON w.chat_id IN (c.chat_id, 0)")


RULE_ROWS = "\nUNION ".join([
    *[_eff(name, value, out) for name, (value, out) in L.BUNDLE.items()],
    "SELECT chat_id, 'allow_usernames', lower(username) FROM admins WHERE chat_id IN "
    "(SELECT chat_id FROM managed_chats)",
    "SELECT chat_id, 'allow_usernames', 'guardian' FROM managed_chats"])


@query("chat_rules", with_views(RULE_ROWS, "managed_chats", "admins", *L.BUNDLE))
def _chat_rules(spark, sf_dir):
    return L.effective_entries(lists_of(spark, sf_dir, *L.BUNDLE),
                               load(spark, sf_dir, "managed_chats"), load(spark, sf_dir, "admins"),
                               "Guardian")


@query("chat_rule_bundle", with_views(
    f"SELECT c.chat_id, string_agg(v, '|' ORDER BY v) AS phrases FROM managed_chats c JOIN "
    f"(SELECT DISTINCT c.chat_id, {sql_keep('phrase')} || '/' || {sql_norm('phrase')} AS v FROM "
    "managed_chats c JOIN keyword_blacklist w ON w.chat_id IN (c.chat_id, 0)) USING (chat_id) "
    "GROUP BY 1", "managed_chats", "keyword_blacklist"))
def _chat_bundle(spark, sf_dir):
    only = ("keyword_blacklist",)
    entries = L.effective_entries(lists_of(spark, sf_dir, *only),
                                  load(spark, sf_dir, "managed_chats"), names=only)
    forms = F.transform("phrases", lambda p: F.concat(p["keep"], F.lit("/"), p["plain"]))
    return L.chat_rules(entries, only).select("chat_id", joined(forms).alias("phrases"))


# --- look-ups ----------------------------------------------------------------------------

URLS_SQL = """
SELECT c.chat_id, page_id, url, EXISTS (SELECT 1 FROM chat_whitelist w WHERE w.chat_id IN (c.chat_id, 0)
  AND (host = lower(split_part(domain, '/', 1)) OR ends_with(host, '.' || lower(split_part(domain, '/', 1))))
  AND (trim(regexp_extract(domain, '^[^/]*/(.*)$', 1), '/') = ''
    OR path = trim(regexp_extract(domain, '^[^/]*/(.*)$', 1), '/')
    OR starts_with(path, trim(regexp_extract(domain, '^[^/]*/(.*)$', 1), '/') || '/'))) AS allowed
FROM managed_chats c CROSS JOIN (SELECT page_id, url,
  lower(regexp_extract(url, '^(?:[a-z]+://)?(?:www\\.)?([^/?#:]+)', 1)) AS host,
  trim(lower(regexp_extract(url, '^[a-z]+://[^/]*/([^?#]*)', 1)), '/') AS path FROM links)"""


@query("url_allowed", with_views(URLS_SQL, "managed_chats", "chat_whitelist", "links"))
def _url_allowed(spark, sf_dir):
    ids = load(spark, sf_dir, "managed_chats").select(F.collect_set("chat_id")).scalar()
    urls = load(spark, sf_dir, "links").select(F.explode(ids).alias("chat_id"), "page_id", "url")
    return L.url_allowed(urls, load(spark, sf_dir, "chat_whitelist"))


def _unknown_sql(list_name, value, items):
    return with_views(
        f"SELECT message_id, x.chat_id, {value} FROM (SELECT message_id, chat_id, unnest({items}) "
        f"AS {value} FROM messages) x WHERE NOT EXISTS (SELECT 1 FROM {list_name} w WHERE "
        f"w.chat_id IN (x.chat_id, 0) AND w.{value} = x.{value})", "messages", list_name)


@query("unknown_mentions", _unknown_sql("username_whitelist", "username", mentions_sql("text")))
def _unknown_mentions(spark, sf_dir):
    h = messages(spark, sf_dir).select(
        "message_id", "chat_id", F.explode(E.extract_mentions("text")).alias("username"))
    out = L.unknown_mentions(h, load(spark, sf_dir, "username_whitelist"))
    return out.select("message_id", "chat_id", "username")


@query("unknown_phones", _unknown_sql("phone_whitelist", "phone", phones_sql("text")))
def _unknown_phones(spark, sf_dir):
    h = messages(spark, sf_dir).select(
        "message_id", "chat_id", F.explode(E.extract_phones("text")).alias("phone"))
    out = L.unknown_phones(h, load(spark, sf_dir, "phone_whitelist"))
    return out.select("message_id", "chat_id", "phone")


SLIM = ("message_id", "chat_id", "user_id", "sender_chat_id", "linked_chat_id",
        "is_automatic_forward", "user_is_bot", "ts_s")
BLOCKED = ("EXISTS (SELECT 1 FROM blacklist b WHERE b.chat_id IN (m.chat_id, 0) "
           "AND b.entity_id = coalesce(m.sender_chat_id, m.user_id))")


def slim(spark, sf_dir):
    return load(spark, sf_dir, "messages").select(*SLIM)


@query("blocked_sender", with_views(
    f"SELECT message_id, {BLOCKED} AS is_blocked FROM messages m", "messages", "blacklist"))
def _blocked(spark, sf_dir):
    return L.blocked_sender(slim(spark, sf_dir), load(spark, sf_dir, "blacklist")).select(
        "message_id", "is_blocked")


@query("blocked_sender_as_of", with_views(
    "SELECT message_id, EXISTS (SELECT 1 FROM held h WHERE h.message_id = m.message_id AND op = 'add') "
    "AS is_blocked FROM messages m", "messages", "blacklist", "blacklist_log", more="""
every AS (SELECT chat_id, entity_id, -1 AS ts_s, -1 AS id, 'add' AS op FROM blacklist
  UNION ALL SELECT chat_id, entity_id, ts_s, id, op FROM blacklist_log),
held AS (SELECT message_id, e.chat_id, arg_max(op, (e.ts_s, e.id)) AS op FROM messages m JOIN every e
  ON e.entity_id = coalesce(m.sender_chat_id, m.user_id) AND e.chat_id IN (m.chat_id, 0) AND e.ts_s <= m.ts_s
  GROUP BY 1, 2)"""))
def _blocked_as_of(spark, sf_dir):
    held = L.list_ranges(load(spark, sf_dir, "blacklist"), load(spark, sf_dir, "blacklist_log"), ["chat_id", "entity_id"])
    return L.blocked_sender(slim(spark, sf_dir), held).select("message_id", "is_blocked")


@query("forward_exempt", with_views(
    f"SELECT message_id, sender_chat_id IS NULL AND NOT {BLOCKED} AND EXISTS (SELECT 1 FROM "
    "forward_whitelist f WHERE f.chat_id IN (m.chat_id, 0) AND f.user_id = m.user_id) "
    "AS may_forward FROM messages m", "messages", "blacklist", "forward_whitelist"))
def _forward_exempt(spark, sf_dir):
    m = L.blocked_sender(slim(spark, sf_dir), load(spark, sf_dir, "blacklist"))
    return L.forward_exempt(m, load(spark, sf_dir, "forward_whitelist")).select(
        "message_id", "may_forward")


@query("exclude_exempt", with_views("""
SELECT message_id FROM messages m WHERE NOT is_automatic_forward
  AND (sender_chat_id IS NULL OR (sender_chat_id <> chat_id AND sender_chat_id <> linked_chat_id))
  AND (sender_chat_id IS NOT NULL OR NOT (user_is_bot OR user_id = 6
    OR user_id IN (SELECT user_id FROM bot_admins)
    OR EXISTS (SELECT 1 FROM admins a WHERE a.chat_id = m.chat_id AND a.user_id = m.user_id)))""",
    "messages", "admins", "bot_admins"))
def _exempt(spark, sf_dir):
    return L.exclude_exempt(slim(spark, sf_dir), load(spark, sf_dir, "admins"),
                            load(spark, sf_dir, "bot_admins"), owners=(6,)).select("message_id")


@query("exclude_trusted", with_views(
    f"SELECT message_id FROM messages m WHERE {BLOCKED} OR sender_chat_id IS NOT NULL OR NOT EXISTS "
    "(SELECT 1 FROM members t WHERE t.trusted AND t.chat_id = m.chat_id AND t.user_id = m.user_id)",
    "messages", "blacklist", "members"))
def _trusted(spark, sf_dir):
    m = L.blocked_sender(slim(spark, sf_dir), load(spark, sf_dir, "blacklist"))
    return L.exclude_trusted(m, load(spark, sf_dir, "members")).select("message_id")


@query("require_known_admins", with_views(
    "SELECT message_id FROM messages WHERE chat_id IN (SELECT chat_id FROM admin_status "
    "WHERE known)", "messages", "admin_status"))
def _known(spark, sf_dir):
    return L.require_known_admins(slim(spark, sf_dir), load(spark, sf_dir, "admin_status")).select(
        "message_id")


# settings changes happen along January, messages on and on: compare at the events themselves
_AS_OF = """SELECT m.event_id, l.value AS action FROM (SELECT *, {epoch} AS ts_s FROM events) m
ASOF LEFT JOIN (SELECT ts_s, arg_max(value, id) AS value FROM settings_log WHERE key = '{key}'
GROUP BY 1) l ON m.ts_s >= l.ts_s"""
_EPOCH_SQL = "CAST(floor(epoch(ts)) AS BIGINT)"


def _events_as_messages(spark, sf_dir):
    everything = load(spark, sf_dir, "service_messages")
    return everything.select(F.col("message_id").alias("event_id"), "ts_s")


@query("settings_as_of", with_views(_AS_OF.format(epoch=_EPOCH_SQL, key="action"), "settings_log"))
def _settings_as_of(spark, sf_dir):
    return settings_as_of(_events_as_messages(spark, sf_dir), load(spark, sf_dir, "settings_log"),
                          "action", "action").select("event_id", "action")


@query("exclude_paused", with_views(
    "SELECT event_id FROM (" + _AS_OF.format(epoch=_EPOCH_SQL, key="pause_until")
    + f") JOIN events USING (event_id) WHERE NOT coalesce(CAST(action AS BIGINT) > {_EPOCH_SQL}, "
    "false)", "settings_log"))
def _paused(spark, sf_dir):
    return exclude_paused(_events_as_messages(spark, sf_dir),
                          load(spark, sf_dir, "settings_log")).select("event_id")
