"""Reports over offences, lists and members."""

from pyspark.sql import functions as F

from ..functions import entities as E
from ..operators import actions as A
from ..operators.lists import latest_settings
from ..plans import reports as P
from .base import messages, query, with_views
from .list_checks import _SETTINGS_SQL, BLOCKED
from .rule_checks import (BANNED_VIEWS, CFG, FEATURE_SOURCES, SCORE_VIEWS, lists_of, scored)
from .state_checks import _SVC_SQL, service_settings
from .views import load, table

NOW = 1706600000
OWNERS = (17,)


def offences(spark, sf_dir):
    return load(spark, sf_dir, "offences")


@query("chat_stats", with_views(
    f"SELECT chat_id, count(*) AS offences, count(*) FILTER (action = 'ban') AS bans, "
    f"count(*) FILTER (ts_s > {NOW - 86400}) AS last_day FROM offences GROUP BY 1", "offences"))
def _chat_stats(spark, sf_dir):
    return P.chat_stats(offences(spark, sf_dir), NOW)


@query("recent_bans", with_views(
    "SELECT id, chat_id, user_id, ts_s, score, reasons, excerpt, name FROM offences "
    "WHERE action IN ('ban', 'mute') ORDER BY ts_s DESC, id DESC LIMIT 10", "offences"))
def _recent_bans(spark, sf_dir):
    return P.recent_bans(offences(spark, sf_dir), 10)


@query("banned_users", with_views(
    "SELECT DISTINCT user_id FROM offences WHERE action IN ('ban', 'mute') AND user_id > 0",
    "offences"))
def _banned_users(spark, sf_dir):
    return A.banned_users(offences(spark, sf_dir)).orderBy("user_id")


@query("banned_pairs", with_views(
    "SELECT DISTINCT chat_id, user_id FROM offences WHERE action IN ('ban', 'mute')", "offences"))
def _banned_pairs(spark, sf_dir):
    return A.banned_pairs(offences(spark, sf_dir))


@query("recent_ban_count", with_views(
    f"SELECT count(*) AS bans FROM offences WHERE action IN ('ban', 'mute') "
    f"AND ts_s >= {NOW - 3600}", "offences"))
def _recent_count(spark, sf_dir):
    return P.recent_ban_count(offences(spark, sf_dir), NOW, 3600)


_COUNTS = ", ".join(f"(SELECT count(*) FROM {n} x WHERE x.chat_id = c.chat_id) AS {n}"
                    for n in P.COUNTED)


@query("list_counts", with_views(
    f"SELECT chat_id, {_COUNTS} FROM (" + " UNION ".join(
        f"SELECT chat_id FROM {n}" for n in P.COUNTED) + ") c", *P.COUNTED))
def _list_counts(spark, sf_dir):
    return P.list_counts(lists_of(spark, sf_dir, *P.COUNTED))


@query("status_report", with_views(f"""
SELECT c.chat_id, title, (SELECT count(*) FROM offences o WHERE o.chat_id = c.chat_id) AS offences,
  (SELECT count(*) FROM offences o WHERE o.chat_id = c.chat_id AND action = 'ban') AS bans,
  (SELECT count(*) FROM offences o WHERE o.chat_id = c.chat_id AND ts_s > {NOW - 86400}) AS last_day,
  (SELECT count(*) FROM keyword_blacklist o WHERE o.chat_id = c.chat_id) AS keyword_blacklist,
  (SELECT count(*) FROM forward_whitelist o WHERE o.chat_id = c.chat_id) AS forward_whitelist,
  (SELECT count(*) FROM blacklist o WHERE o.chat_id = c.chat_id) AS blacklist,
  (SELECT coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (kind <> ''), '') FROM wanted w
   WHERE w.chat_id = c.chat_id) AS service_kinds,
  coalesce((SELECT CASE WHEN lower(trim(value)) IN ('ban', 'mute', 'delete', 'report')
    THEN lower(trim(value)) END FROM latest WHERE key = 'action'), 'ban') AS action
FROM managed_chats c""", "offences", "managed_chats", "settings_log", *P.COUNTED,
    more=_SVC_SQL.strip() + ",\n" + _SETTINGS_SQL))
def _status(spark, sf_dir):
    settings = latest_settings(load(spark, sf_dir, "settings_log")).unionByName(
        service_settings(spark, sf_dir))
    return P.status_report(offences(spark, sf_dir), lists_of(spark, sf_dir, *P.COUNTED),
                           load(spark, sf_dir, "managed_chats"), settings, CFG, NOW)


FLAGS = """
here AS (SELECT user_id, count(DISTINCT chat_id) AS chats FROM memberships WHERE status <> 'left'
  AND chat_id IN (SELECT chat_id FROM managed_chats) GROUP BY 1),
people AS (SELECT s.*, coalesce(chats, 0) AS chats FROM starters s LEFT JOIN here USING (user_id)
  WHERE user_id <> 17 AND user_id NOT IN (SELECT user_id FROM bot_admins)),
flags AS (SELECT *, CASE WHEN user_id IN (SELECT user_id FROM forward_whitelist WHERE chat_id = 0)
  THEN 'already' WHEN chats >= (SELECT floor(count(*) * 2 / 3) FROM managed_chats) THEN 'qualifies'
  ELSE 'few' END AS flag FROM people)"""
FLAG_VIEWS = ("memberships", "managed_chats", "starters", "bot_admins", "forward_whitelist")


def _flags(spark, sf_dir):
    v = lists_of(spark, sf_dir, *FLAG_VIEWS)
    return P.seeding_flags(v["starters"], v["memberships"], v["bot_admins"],
                           v["forward_whitelist"], v["managed_chats"], OWNERS)


@query("seeding_flags", with_views(
    "SELECT user_id, name, username, chats, flag FROM flags", *FLAG_VIEWS, more=FLAGS))
def _seeding_flags(spark, sf_dir):
    return _flags(spark, sf_dir).select("user_id", "name", "username", "chats", "flag")


@query("seeding_candidates", with_views(
    "SELECT user_id, name, username, chats, flag FROM flags ORDER BY chats DESC, ts_s DESC, "
    "user_id LIMIT 40", *FLAG_VIEWS, more=FLAGS))
def _seeding(spark, sf_dir):
    return P.seeding_candidates(_flags(spark, sf_dir))


@query("accept_candidates", with_views(
    "SELECT chat_id, user_id FROM forward_whitelist UNION SELECT 0, user_id FROM flags "
    "WHERE flag = 'qualifies'", *FLAG_VIEWS, more=FLAGS))
def _accept(spark, sf_dir):
    return P.accept_candidates(_flags(spark, sf_dir), load(spark, sf_dir, "forward_whitelist"))


@query("undo_last_ban", with_views("""
SELECT id FROM offences WHERE (chat_id, user_id) <> (SELECT (chat_id, user_id) FROM offences
  WHERE action IN ('ban', 'mute') ORDER BY ts_s DESC, id DESC LIMIT 1)""", "offences"))
def _undo(spark, sf_dir):
    return P.undo_last_ban(offences(spark, sf_dir))[0].select("id")


@query("list_view", with_views(
    "SELECT DISTINCT CASE WHEN chat_id = 0 THEN 'shared' ELSE 'own' END AS scope, phrase AS entry "
    "FROM keyword_blacklist WHERE chat_id IN (0, 3)", "keyword_blacklist"))
def _list_view(spark, sf_dir):
    return P.list_view(load(spark, sf_dir, "keyword_blacklist"), "phrase", 3)


@query("detection_quality", with_views("""
SELECT toxic = 1 AS expected, count(*) AS messages, count(*) FILTER (score >= threshold) AS flagged,
  count(*) FILTER ((score >= threshold) <> (toxic = 1)) AS failures
FROM scores JOIN labels ON doc_id = message_id GROUP BY 1""", *FEATURE_SOURCES, more=SCORE_VIEWS))
def _quality(spark, sf_dir):
    v = scored(spark, sf_dir).select(F.col("message_id").alias("id"),
                                     F.col("verdict.is_spam").alias("is_spam"))
    truth = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("expected"))
    return P.detection_quality(v, truth)


@query("panel_summary", with_views(f"""
SELECT CASE WHEN until > {NOW} THEN 'paused' WHEN action = 'report' THEN 'trial' ELSE 'protecting'
  END AS state, action, CASE WHEN until > {NOW} THEN (until - {NOW}) // 60 END AS minutes_left,
  (SELECT count(*) FROM offences WHERE action IN ('ban', 'mute') AND ts_s >= {NOW - 3600})
    AS bans_last_hour, false AS braked_today
FROM (SELECT (SELECT CAST(value AS BIGINT) FROM latest WHERE key = 'pause_until') AS until,
  coalesce((SELECT CASE WHEN lower(trim(value)) IN ('ban', 'mute', 'delete', 'report')
    THEN lower(trim(value)) END FROM latest WHERE key = 'action'), 'ban') AS action)""",
    "offences", "settings_log", more=_SETTINGS_SQL))
def _panel(spark, sf_dir):
    return P.panel_summary(latest_settings(load(spark, sf_dir, "settings_log")),
                           offences(spark, sf_dir), CFG, NOW)


@query("preset_summary", with_views(
    "SELECT name, label, count(*) AS phrases FROM presets GROUP BY 1, 2", "presets"))
def _preset_summary(spark, sf_dir):
    return P.preset_summary(load(spark, sf_dir, "presets"))


# a dry run scores old members with no lists, no name, no question exemption
DRY = SCORE_VIEWS
_DRY_SOURCES = {
    "messages": "SELECT * REPLACE ('' AS sender_name, false AS is_new_member, "
                "true AS has_entities) FROM messages0",
    "chat_whitelist": "SELECT CAST(0 AS BIGINT) AS chat_id, '' AS domain WHERE false",
    "username_whitelist": "SELECT CAST(0 AS BIGINT) AS chat_id, '' AS username WHERE false",
    "phone_whitelist": "SELECT CAST(0 AS BIGINT) AS chat_id, '' AS phone WHERE false",
}


def _dry_sql():
    from .views import view_sql
    views = [f"messages0 AS ({view_sql('messages', 'duckdb')})",
             f"managed_chats AS ({view_sql('managed_chats', 'duckdb')})"]
    views += [f"{n} AS ({q})" for n, q in _DRY_SOURCES.items()]
    views += [f"{n} AS ({view_sql(n, 'duckdb')})"
              for n in ("keyword_blacklist", "blacklist", "forward_whitelist")]
    # the sample QR link is on no list in a dry run
    score = SCORE_VIEWS.replace(" AND qr_payload NOT LIKE '%docs.example.org%'", "")
    more = score + ",\n" + BANNED_VIEWS.strip()
    return "WITH " + ",\n".join(views) + ",\n" + more + f"""
SELECT message_id, s.score, s.reasons, CASE WHEN hits IS NOT NULL THEN 'spam: banned phrase' WHEN {BLOCKED} THEN
  'spam: blocked' WHEN s.score >= s.threshold THEN 'spam' ELSE 'clean' END AS label,
  CASE WHEN hits IS NOT NULL THEN array_to_string(hits[1:5], ', ') WHEN {BLOCKED} THEN 'blocked sender'
    WHEN sender_chat_id IS NULL AND EXISTS (SELECT 1 FROM forward_whitelist f WHERE f.chat_id IN
    (m.chat_id, 0) AND f.user_id = m.user_id) THEN 'may forward' ELSE '' END AS note
FROM messages m JOIN scores s USING (message_id) LEFT JOIN banned USING (message_id)"""


@query("explain_message", _dry_sql())
def _explain(spark, sf_dir):
    m = messages(spark, sf_dir).withColumn("forward_label", E.forward_label("forward_origin"))
    out = P.explain_messages(m, load(spark, sf_dir, "keyword_blacklist"),
                             load(spark, sf_dir, "blacklist"),
                             load(spark, sf_dir, "forward_whitelist"),
                             load(spark, sf_dir, "managed_chats"), CFG)
    return out.select("message_id", F.col("verdict.score").cast("bigint").alias("score"),
                      F.array_join("verdict.reasons", "; ").alias("reasons"), "label", "note")
