"""History, replay, brakes, actions and streams."""

from pyspark.sql import functions as F

from ..config import ModerationConfig
from ..functions import entities as E
from ..operators import actions as A
from ..operators import images as I
from ..operators import state as T
from ..operators.scoring import score_both, text_features, without_texts
from ..plans.moderate import moderate, moderate_to_log
from ..sources.storage import new_folder
from ..sources.tables import read_message_stream, read_offences
from ..streaming import live
from ..streaming.brake import stream_ban_brake
from .base import messages, query, with_views
from .rule_checks import (BANNED_VIEWS, BENIGN_SQL, CFG, FEATURES, FEATURE_SOURCES, FWD_WEAK, LISTS, NORM_OF_TEXT, RULES_SQL,
                          UNION, attach, lists_of, prepared)
from .views import load, stream_path, table, table_stream, view_sql

SLIM = ("message_id", "chat_id", "user_id", "sender_chat_id", "ts_s")

ACTIVITY = """
ev AS (SELECT chat_id, user_id, ts_s, 1 AS is_msg, message_id AS id FROM messages
  WHERE sender_chat_id IS NULL
  UNION ALL SELECT chat_id, user_id, ts_s, 0, id FROM joins),
act AS (SELECT *, min(ts_s) OVER w AS first_seen, CAST(sum(is_msg) OVER w AS BIGINT) AS msg_count
  FROM ev WINDOW w AS (PARTITION BY chat_id, user_id ORDER BY ts_s, is_msg, id
  ROWS UNBOUNDED PRECEDING))"""


def slim(spark, sf_dir):
    return load(spark, sf_dir, "messages").select(*SLIM)


@query("member_activity", with_views(
    "SELECT id AS message_id, first_seen, msg_count FROM act WHERE is_msg = 1", "messages",
    "joins", more=ACTIVITY))
def _activity(spark, sf_dir):
    return T.member_activity(slim(spark, sf_dir), load(spark, sf_dir, "joins")).select(
        "message_id", "first_seen", "msg_count")


@query("new_member_flag", with_views(
    "SELECT id AS message_id, ts_s - first_seen < 86400 OR msg_count <= 3 AS is_new_member "
    "FROM act WHERE is_msg = 1", "messages", "joins", more=ACTIVITY))
def _new_flag(spark, sf_dir):
    a = T.member_activity(slim(spark, sf_dir), load(spark, sf_dir, "joins"))
    return T.new_member_flag(a, CFG).select("message_id", "is_new_member")


def past_offences(spark, sf_dir):
    return load(spark, sf_dir, "offences").withColumn("user_id", 1 + F.col("user_id") % 37)


@query("prior_offences", with_views(
    "SELECT m.message_id, (SELECT count(*) FROM offences o WHERE o.chat_id = m.chat_id AND "
    "1 + o.user_id % 37 = m.user_id AND o.ts_s < m.ts_s) AS prior_offences FROM messages m "
    "WHERE sender_chat_id IS NULL", "messages", "offences"))
def _prior(spark, sf_dir):
    return T.prior_offences(slim(spark, sf_dir), past_offences(spark, sf_dir)).select(
        "message_id", "prior_offences")


# --- replay ------------------------------------------------------------------------------

EDITED_AFTER = 150_000
MODE = "CASE WHEN message_id % 4 = 3 THEN 'delete' WHEN message_id % 7 = 2 THEN 'mute' " \
       "ELSE 'ban' END"


def _points(tag, is_new, t):
    rows = UNION.replace("FROM g ", f"FROM g_{tag} ")
    return f"""
g_{tag} AS (SELECT * REPLACE ({is_new} AS is_new_member, {t} AS t) FROM g),
sum_{tag} AS (SELECT message_id, sum(hard * {t} + soft) AS p FROM ({rows}) GROUP BY 1)"""


REPLAY = FEATURES + f""",
g AS (SELECT f.*, length(regexp_replace(body, '[^A-Za-z]', '', 'g')) AS latin,
  length(regexp_replace(lower(body), '[^авсеѕһіјкмнортухԁɡναβεικορτυχϲ]', '', 'g')) AS fakes,
  {NORM_OF_TEXT} AS n FROM f),
{_points('new', 'TRUE', 3)}, {_points('old', 'FALSE', 5)},
pts AS (SELECT message_id, m.chat_id, m.user_id, m.sender_chat_id, m.ts_s, {MODE} AS mode,
  coalesce(a.p, 0) AS p_new, coalesce(b.p, 0) AS p_old FROM (
    SELECT * FROM messages UNION ALL
    SELECT * REPLACE (ts_s + {EDITED_AFTER} AS ts_s) FROM messages WHERE message_id % 7 = 0) m
  LEFT JOIN sum_new a USING (message_id) LEFT JOIN sum_old b USING (message_id)),
ev AS (SELECT *, row_number() OVER (PARTITION BY chat_id, user_id ORDER BY ts_s, is_msg, id) AS rn
  FROM (SELECT chat_id, user_id, ts_s, 1 AS is_msg, message_id AS id, p_new, p_old, mode FROM pts
    WHERE sender_chat_id IS NULL
    UNION ALL SELECT chat_id, user_id, ts_s, 0, id, 0, 0, NULL FROM joins
    UNION ALL SELECT chat_id, 1 + user_id % 37, ts_s, 2, id, 0, 0, NULL FROM offences)),
fold AS (
  SELECT k.chat_id, k.user_id, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS first_seen,
    CAST(0 AS BIGINT) AS cnt, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS message_id,
    CAST(NULL AS BIGINT) AS ts_s, FALSE AS is_new, CAST(0 AS BIGINT) AS prior,
    CAST(0 AS BIGINT) AS score, FALSE AS spam
  FROM (SELECT DISTINCT chat_id, user_id FROM ev) k
  UNION ALL
  SELECT chat_id, user_id, rn, CASE WHEN spam AND mode = 'ban' THEN NULL ELSE fs END,
    CASE WHEN spam AND mode = 'ban' THEN 0 ELSE cnt END,
    prior + CASE WHEN spam OR is_msg = 2 THEN 1 ELSE 0 END, id, ts_s, is_new, prior, score, spam
  FROM (SELECT *, is_msg = 1 AND score >= CASE WHEN is_new THEN 3 ELSE 5 END AS spam
    FROM (SELECT *, CAST(CASE WHEN is_new THEN p_new ELSE p_old END + CASE WHEN
        CASE WHEN is_new THEN p_new ELSE p_old END > 0 THEN least(2 * prior, 4) ELSE 0 END AS BIGINT)
        AS score
      FROM (SELECT *, ts_s - fs < 86400 OR cnt <= 3 AS is_new
        FROM (SELECT e.chat_id, e.user_id, e.rn,
            CASE WHEN e.is_msg = 2 THEN f.first_seen ELSE coalesce(f.first_seen, e.ts_s) END AS fs,
            f.cnt + CASE WHEN e.is_msg = 1 THEN 1 ELSE 0 END AS cnt, f.n AS prior, e.id, e.is_msg, e.ts_s, e.p_new, e.p_old, e.mode
          FROM fold f JOIN ev e ON e.chat_id = f.chat_id AND e.user_id = f.user_id
            AND e.rn = f.rn + 1)))))"""
REPLAY_SOURCES = (*FEATURE_SOURCES, "joins", "offences")
_USERS = ("SELECT message_id, ts_s, user_id AS offender_id, is_new, prior AS prior_offences, score "
          "FROM fold WHERE spam")
_CHANNELS = ("SELECT message_id, ts_s, sender_chat_id, FALSE, CAST(0 AS BIGINT), CAST(p_old AS BIGINT) "
             "FROM pts WHERE sender_chat_id IS NOT NULL AND p_old >= 5")

USERS_AND_CHANNELS = f"{_USERS} UNION ALL {_CHANNELS}"

def scored_both(spark, sf_dir, m=None):
    m = prepared(spark, sf_dir) if m is None else m
    features = without_texts(text_features(m, CFG))
    return score_both(attach(spark, sf_dir)(features), CFG).withColumns({
        "forced_reason": F.lit(None).cast("string"), "action": F.expr(MODE)})


def with_edits(m):
    """Some messages come once more, edited later, under the same number."""
    edited = m.filter("message_id % 7 = 0").withColumn("ts_s", F.col("ts_s") + EDITED_AFTER)
    return m.unionByName(edited)


def replayed(spark, sf_dir):
    return T.replay_verdicts(scored_both(spark, sf_dir, with_edits(prepared(spark, sf_dir))),
                             load(spark, sf_dir, "joins"), CFG, offences=past_offences(spark, sf_dir))


@query("replay_verdicts", with_views(USERS_AND_CHANNELS, *REPLAY_SOURCES,
                                     more=REPLAY, recursive=True))
def _replay(spark, sf_dir):
    return replayed(spark, sf_dir).select(
        "message_id", "ts_s", "offender_id", "is_new", "prior_offences",
        F.col("verdict.score").cast("bigint").alias("score"))


#: More files than a scored batch has: history wants its rows in order of time, so none is read in parts.
WHOLE_BATCH = 100_000


def scored_folder(spark, sf_dir):
    """First query of the live pipeline: the documents as a stream, scored batch by batch."""
    path, checkpoint = new_folder(spark, "scored"), new_folder(spark, "scoring")
    docs = table_stream(spark, sf_dir, "documents")
    more = load(spark, sf_dir, "joins"), past_offences(spark, sf_dir)

    def score(batch, batch_id):
        m = with_edits(spark_messages(batch))
        return live.stream_rows(scored_both(spark, sf_dir, m), *(more if batch_id == 0 else ()))

    live.start_batches(docs, score, path, checkpoint, available_now=True).awaitTermination()
    return path


def spark_messages(documents):
    m = documents.sparkSession.sql(view_sql("messages", "spark"), documents=documents)
    payloads = F.when(F.col("qr_payload").isNotNull(), F.array("qr_payload")).otherwise(
        F.array().cast("array<string>"))
    return m.withColumns({"qr_payloads": payloads,
                          "forward_label": E.forward_label("forward_origin")}).drop("qr_payload")


@query("stream_verdicts", with_views(USERS_AND_CHANNELS, *REPLAY_SOURCES,
                                     more=REPLAY, recursive=True))
def _stream_verdicts(spark, sf_dir):
    scored_path = scored_folder(spark, sf_dir)
    out = live.stream_verdicts(live.read_scored(spark, scored_path, WHOLE_BATCH), CFG)
    path = new_folder(spark, "live")
    live.start_offence_sink(out, path, new_folder(spark, "sink"), True).awaitTermination()
    done = spark.read.parquet(path)
    return done.select("message_id", "ts_s", F.col("user_id").alias("offender_id"), "is_new",
                       "prior_offences", "score")


@query("read_message_stream", "SELECT doc_id AS message_id, 1 + doc_id % 5 AS chat_id, "
                              "text FROM documents")
def _message_stream(spark, sf_dir):
    stream = read_message_stream(
        spark, stream_path(sf_dir, "documents"), table(spark, sf_dir, "documents").schema, start="earliest",
        mapping={"message_id": "doc_id", "chat_id": "1 + doc_id % 5"})
    path = new_folder(spark, "stream")
    live.start_offence_sink(stream, path, new_folder(spark, "cp"), True).awaitTermination()
    return spark.read.parquet(path).select("message_id", "chat_id", "text")


@query("stream_rule_refresh", with_views(
    "SELECT page_id, EXISTS (SELECT 1 FROM chat_whitelist w WHERE w.chat_id = 0 AND "
    "split_part(split_part(url, '://', 2), '/', 1) = domain) AS listed FROM links",
    "links", "chat_whitelist"))
def _rule_refresh(spark, sf_dir):
    pages = table_stream(spark, sf_dir, "pages").select("page_id", "url")
    path = new_folder(spark, "refresh")

    def score(batch, lists):
        own = lists["chat_whitelist"].filter("chat_id = 0").select(
            F.col("domain").alias("host"), F.lit(True).alias("_ok")).distinct()
        host = F.substring_index(F.substring_index("url", "://", -1), "/", 1)
        return batch.withColumn("host", host).join(own, "host", "left").select(
            "page_id", F.coalesce("_ok", F.lit(False)).alias("listed"))

    each = live.refresh_rules(lambda: lists_of(spark, sf_dir, "chat_whitelist"), score)
    live.start_batches(pages, each, path, new_folder(spark, "cp"), True).awaitTermination()
    return spark.read.parquet(path).select("page_id", "listed")


BURST = """
sec AS (SELECT ts_s, count(*) AS bans FROM offences WHERE action IN ('ban', 'mute') GROUP BY 1),
burst AS (SELECT ts_s, bans, CAST(sum(bans) OVER (ORDER BY ts_s RANGE BETWEEN {w} PRECEDING AND
  CURRENT ROW) AS BIGINT) AS recent_bans FROM sec)"""


@query("ban_brake", with_views(
    "SELECT ts_s, bans, recent_bans, recent_bans >= 5 AS brake FROM burst", "offences",
    more=BURST.format(w=3600)))
def _ban_brake(spark, sf_dir):
    return T.ban_brake(load(spark, sf_dir, "offences"), 5, 3600)


def _event_stream(spark, sf_dir):
    events = table_stream(spark, sf_dir, "events")
    rows = spark.sql(view_sql("offences", "spark"), events=events)
    return rows.withColumn("ts", F.timestamp_seconds("ts_s"))


@query("stream_ban_brake", with_views(
    "SELECT ts_s, recent_bans FROM burst WHERE recent_bans >= 2", "offences", more=BURST.format(w=60)))
def _stream_brake(spark, sf_dir):
    # a ban a day after the others closes all their windows; its own stays open
    rows = load(spark, sf_dir, "offences").select("id", "ts_s", "action")
    closing = rows.agg(F.lit(-1).cast("bigint").alias("id"), (F.max("ts_s") + T.DAY).alias("ts_s"),
                       F.lit("ban").alias("action"))
    folder = new_folder(spark, "bans")
    rows.unionByName(closing).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder).withColumn("ts", F.timestamp_seconds("ts_s"))
    path = new_folder(spark, "brake")
    live.start_offence_sink(stream_ban_brake(stream, 2, 60), path, new_folder(spark, "cp"),
                            True).awaitTermination()
    return spark.read.parquet(path).select("ts_s", "recent_bans")


@query("stream_offence_sink", with_views(
    "SELECT id, chat_id, user_id, ts_s, score, action FROM offences", "offences"))
def _offence_sink(spark, sf_dir):
    path = new_folder(spark, "offences")
    live.start_offence_sink(_event_stream(spark, sf_dir), path, new_folder(spark, "cp"),
                            True).awaitTermination()
    return spark.read.parquet(path).select("id", "chat_id", "user_id", "ts_s", "score", "action")


@query("dedupe_edits", "SELECT DISTINCT user_id AS message_id, CAST(floor(value) AS BIGINT) % 3 "
                       "AS edited_s FROM events")
def _dedupe(spark, sf_dir):
    events = table_stream(spark, sf_dir, "events")
    edits = events.select(F.col("ts").cast("timestamp").alias("ts"),
                          F.col("user_id").alias("message_id"),
                          (F.floor("value") % 3).alias("edited_s"))
    path = new_folder(spark, "edits")
    live.start_offence_sink(live.dedupe_edits(edits, "60 days"), path, new_folder(spark, "cp"),
                            True).awaitTermination()
    return spark.read.parquet(path).select("message_id", "edited_s")


# --- the brake fed back, forgiveness ------------------------------------------------------


@query("apply_brake", with_views("""
SELECT id, ts_s, action, eff AS effective_action FROM fold WHERE kind = 1
UNION ALL SELECT e.id, e.ts_s, e.action, CASE WHEN f.off THEN 'report' ELSE e.action END
FROM (SELECT * FROM ev WHERE kind = 1 AND action NOT IN ('ban', 'mute')) e
ASOF JOIN fold f ON e.rn >= f.rn""", "offences", "settings_log", more="""
ev AS (SELECT *, row_number() OVER (ORDER BY ts_s, kind, id) AS rn FROM (
  SELECT id, ts_s, action, 1 AS kind FROM offences
  UNION ALL SELECT id, ts_s, value, 0 FROM settings_log WHERE key = 'action'
    AND value IN ('ban', 'mute'))),
steps AS (SELECT *, row_number() OVER (ORDER BY rn) AS step FROM ev
  WHERE kind = 0 OR action IN ('ban', 'mute')),
fold AS (
  SELECT CAST(0 AS BIGINT) AS step, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS id,
    CAST(0 AS BIGINT) AS ts_s, '' AS action, 0 AS kind, '' AS eff, CAST([] AS BIGINT[]) AS recent,
    FALSE AS off
  UNION ALL
  SELECT step, rn, id, ts_s, action, kind, CASE WHEN off0 THEN 'report' ELSE action END, now,
    off0 OR (carried AND len(now) >= 5)
  FROM (SELECT *, CASE WHEN carried THEN list_append(past, ts_s) ELSE past END AS now FROM (
    SELECT e.*, e.kind = 1 AND f.off AS off0, e.kind = 1 AND NOT f.off AS carried,
      list_filter(f.recent, lambda t: t >= e.ts_s - 3600) AS past
    FROM fold f JOIN steps e ON e.step = f.step + 1)))""", recursive=True))
def _apply_brake(spark, sf_dir):
    cfg = ModerationConfig(brake_limit=5, brake_window=3600)
    o = load(spark, sf_dir, "offences").select("id", "ts_s", "action")
    return T.apply_brake(o, brake_resets(spark, sf_dir), cfg)


def brake_resets(spark, sf_dir):
    return load(spark, sf_dir, "settings_log").filter(
        "key = 'action' AND value IN ('ban', 'mute')").select("id", "ts_s")


_CHANGES = """
changes AS (SELECT event_id, 1 + event_id % 5 AS chat_id, 1 + user_id % 37 AS user_id,
  CAST(floor(epoch(ts)) AS BIGINT) AS ts_s, CASE event_id % 3 WHEN 0 THEN 'trust'
  WHEN 1 THEN 'unban' ELSE 'ban' END AS kind FROM events WHERE event_type = 'click')"""


def _changes(spark, sf_dir):
    e = load(spark, sf_dir, "service_messages").select("message_id", "ts_s")
    clicks = table(spark, sf_dir, "events").filter("event_type = 'click'")
    kinds = F.element_at(F.array(F.lit("trust"), F.lit("unban"), F.lit("ban")),
                         (F.col("event_id") % 3 + 1).cast("int"))
    return clicks.join(e, F.col("event_id") == F.col("message_id")).select(
        (1 + F.col("event_id") % 5).alias("chat_id"), (1 + F.col("user_id") % 37).alias("user_id"),
        "ts_s", kinds.alias("kind"))


@query("clear_history", with_views(
    "SELECT id FROM offences o WHERE NOT EXISTS (SELECT 1 FROM changes c WHERE c.kind <> 'ban' AND "
    "c.chat_id = o.chat_id AND c.user_id = 1 + o.user_id % 37 AND o.ts_s <= c.ts_s)", "offences",
    more=_CHANGES))
def _clear(spark, sf_dir):
    return T.clear_history(past_offences(spark, sf_dir), _changes(spark, sf_dir)).select("id")


@query("member_changes", with_views("""
SELECT chat_id, user_id, min(first_seen) AS first_seen, CAST(max(msg_count) AS BIGINT) AS msg_count,
  bool_or(trusted) AS trusted FROM (
  SELECT chat_id, user_id, first_seen, msg_count, trusted FROM members m WHERE NOT EXISTS
    (SELECT 1 FROM b WHERE b.chat_id = m.chat_id AND b.user_id = m.user_id) AND NOT EXISTS
    (SELECT 1 FROM t WHERE t.chat_id = m.chat_id AND t.user_id = m.user_id)
  UNION ALL SELECT t.chat_id, t.user_id, coalesce(m.first_seen, t.ts_s), coalesce(m.msg_count, 0),
    true FROM (SELECT chat_id, user_id, min(ts_s) AS ts_s FROM t GROUP BY 1, 2) t
  LEFT JOIN (SELECT * FROM members m WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.chat_id = m.chat_id
    AND b.user_id = m.user_id)) m USING (chat_id, user_id)) GROUP BY 1, 2""", "members",
    more=_CHANGES + """,
b AS (SELECT chat_id, user_id, max(ts_s) AS ts_s FROM changes WHERE kind = 'ban' GROUP BY 1, 2),
t AS (SELECT c.chat_id, c.user_id, c.ts_s FROM changes c LEFT JOIN b USING (chat_id, user_id)
  WHERE c.kind = 'trust' AND (b.ts_s IS NULL OR c.ts_s > b.ts_s))"""))
def _member_changes(spark, sf_dir):
    return T.apply_member_changes(load(spark, sf_dir, "members"), _changes(spark, sf_dir))


# --- actions -----------------------------------------------------------------------------


def _cases(spark, sf_dir):
    return load(spark, sf_dir, "messages").select(
        "message_id", "chat_id", F.coalesce("sender_chat_id", "user_id").alias("offender_id"),
        "ts_s", F.col("sender_chat_id").isNotNull().alias("by_channel"),
        F.element_at(F.array(*[F.lit(a) for a in ("ban", "mute", "delete", "report")]),
                     (F.col("message_id") % 4 + 1).cast("int")).alias("mode"))


_RESOLVED = """
r AS (SELECT message_id, chat_id, coalesce(sender_chat_id, user_id) AS offender_id, ts_s,
  sender_chat_id IS NOT NULL AS by_channel, CASE WHEN message_id % 4 = 2 THEN 'delete'
  WHEN message_id % 4 = 3 THEN 'report' WHEN sender_chat_id IS NOT NULL OR message_id % 4 = 0
  THEN 'ban' ELSE 'mute' END AS action FROM messages)"""


@query("resolve_action", with_views(
    "SELECT message_id, action, CASE WHEN action = 'mute' THEN ts_s + 86400 END AS until FROM r",
    "messages", more=_RESOLVED))
def _resolve(spark, sf_dir):
    return A.resolve_action(_cases(spark, sf_dir), CFG).select("message_id", "action", "until")


@query("ban_fanout", with_views("""
SELECT DISTINCT r.offender_id AS user_id, r.chat_id AS from_chat, c.chat_id FROM r, managed_chats c
WHERE action = 'ban' AND NOT by_channel AND c.chat_id <> r.chat_id AND NOT EXISTS (SELECT 1 FROM
  admins a WHERE a.chat_id = c.chat_id AND a.user_id = r.offender_id)""", "messages",
    "managed_chats", "admins", more=_RESOLVED))
def _fanout(spark, sf_dir):
    return A.ban_fanout(A.resolve_action(_cases(spark, sf_dir), CFG),
                        load(spark, sf_dir, "managed_chats"), load(spark, sf_dir, "admins"))


@query("purge_plan", with_views("""
SELECT user_id, chat_id FROM (SELECT DISTINCT user_id FROM offences WHERE action IN ('ban', 'mute')
  AND user_id > 0) u, (SELECT chat_id FROM managed_chats) c
WHERE NOT EXISTS (SELECT 1 FROM offences o WHERE o.action IN ('ban', 'mute') AND
    o.chat_id = c.chat_id AND o.user_id = u.user_id)
  AND NOT EXISTS (SELECT 1 FROM admins a WHERE a.chat_id = c.chat_id AND a.user_id = u.user_id)""",
    "offences", "managed_chats", "admins"))
def _purge(spark, sf_dir):
    return A.purge_plan(load(spark, sf_dir, "offences"), load(spark, sf_dir, "managed_chats"),
                        load(spark, sf_dir, "admins"))


@query("purge_estimate", with_views("""
SELECT users, chats, greatest(users * chats - pairs, 0) AS commands,
  round(greatest(users * chats - pairs, 0) / 600, 4) AS minutes_fast,
  round(greatest(users * chats - pairs, 0) / 300, 4) AS minutes_slow
FROM (SELECT count(DISTINCT user_id) FILTER (user_id > 0) AS users, count(DISTINCT (chat_id, user_id)) AS pairs
  FROM offences WHERE action IN ('ban', 'mute')), (SELECT count(*) AS chats FROM managed_chats)""",
    "offences", "managed_chats"))
def _estimate(spark, sf_dir):
    e = A.purge_estimate(load(spark, sf_dir, "offences"), load(spark, sf_dir, "managed_chats"))
    return e.select("users", "chats", "commands", F.round("minutes_fast", 4).alias("minutes_fast"),
                    F.round("minutes_slow", 4).alias("minutes_slow"))


KIND_SQL = """CASE field WHEN 'new_chat_members' THEN 'join' WHEN 'left_chat_member' THEN 'leave'
  WHEN 'pinned_message' THEN 'pin' WHEN 'new_chat_title' THEN 'title' WHEN 'delete_chat_photo'
  THEN 'photo' WHEN 'video_chat_ended' THEN 'videochat' WHEN 'forum_topic_edited' THEN 'forum'
  ELSE 'other' END"""


@query("classify_service_message", with_views(
    f"SELECT message_id, {KIND_SQL} AS kind FROM service_messages", "service_messages"))
def _classify(spark, sf_dir):
    return load(spark, sf_dir, "service_messages").select(
        "message_id", A.classify_service_message(F.array("field")).alias("kind"))


# chat 1 has its own kinds, chat 2 wants none, the others follow the global setting
_SVC_SQL = """
svc AS (SELECT concat('svc:', n_nationkey) AS key, CASE n_nationkey WHEN 0 THEN 'join,title'
  WHEN 1 THEN 'pin,forum' ELSE '' END AS value FROM nation WHERE n_nationkey <= 2),
wanted AS (SELECT c.chat_id, unnest(string_split(coalesce(own.value, every.value), ',')) AS kind
  FROM managed_chats c LEFT JOIN svc own ON own.key = concat('svc:', c.chat_id)
  LEFT JOIN svc every ON every.key = 'svc:0')"""


def service_settings(spark, sf_dir):
    value = F.when(F.col("n_nationkey") == 0, "join,title").when(
        F.col("n_nationkey") == 1, "pin,forum").otherwise("")
    return table(spark, sf_dir, "nation").filter("n_nationkey <= 2").select(
        F.concat(F.lit("svc:"), F.col("n_nationkey").cast("string")).alias("key"),
        value.alias("value"))


@query("service_delete_plan", with_views(
    f"SELECT message_id, chat_id, kind FROM (SELECT *, {KIND_SQL} AS kind FROM service_messages) "
    "JOIN wanted USING (chat_id, kind)", "service_messages", "managed_chats", more=_SVC_SQL))
def _service_plan(spark, sf_dir):
    m = load(spark, sf_dir, "service_messages").withColumn("fields", F.array("field"))
    return A.service_delete_plan(m, service_settings(spark, sf_dir),
                                 load(spark, sf_dir, "managed_chats"), CFG).select(
        "message_id", "chat_id", "kind")


# --- pictures ------------------------------------------------------------------------------


def pictures(spark, sf_dir):
    r = load(spark, sf_dir, "image_renditions")

    def rendition(long_side):
        side, part = F.lit(long_side), long_side / 1280
        return F.struct(
            F.concat(F.lit(f"f{long_side}_"), F.col("message_id").cast("string")).alias("file_id"),
            F.col("unique_id"), F.floor(F.col("file_size") * part).alias("file_size"),
            side.alias("width"), F.lit(long_side * 3 // 4).alias("height"))

    photo = F.when(F.col("kind") == "photo", F.array(*[rendition(s) for s in (90, 320, 800, 1280)]))
    single = F.struct(F.concat(F.lit("g"), F.col("message_id").cast("string")).alias("file_id"),
                      "unique_id", "file_size", F.lit("image/png").alias("mime_type"), "animated")
    return r.select("message_id", "unique_id", "file_size", photo.alias("photo"),
                    F.when(F.col("kind") == "document", single).alias("document"),
                    F.when(F.col("kind") == "sticker", single).alias("sticker"))


_PICK = """
pick AS (SELECT message_id, unique_id, file_size, CASE
  WHEN kind = 'photo' THEN CASE WHEN file_size <= 5000000 THEN 'f1280_' WHEN floor(file_size * 0.625)
    <= 5000000 THEN 'f800_' WHEN floor(file_size * 0.25) <= 5000000 THEN 'f320_'
    WHEN floor(file_size * 0.0703125) <= 5000000 THEN 'f90_' END
  WHEN file_size > 5000000 OR (kind = 'sticker' AND animated) THEN NULL ELSE 'g' END
  || message_id AS file_id FROM image_renditions)"""
CAP = 5_000_000


@query("pick_rendition", with_views("SELECT message_id, file_id FROM pick", "image_renditions",
                                    more=_PICK))
def _pick(spark, sf_dir):
    return I.pick_rendition(pictures(spark, sf_dir), CAP).select("message_id", "image.file_id")


def decoded(spark, sf_dir):
    s = load(spark, sf_dir, "image_signals")
    return s.select("unique_id", "has_qr", F.when(F.col("has_qr"), F.array("qr_payload")).otherwise(
        F.array().cast("array<string>")).alias("qr_payloads"), "ocr_text")


@query("attach_image_signals", with_views("""
SELECT message_id, coalesce(s.has_qr AND file_id IS NOT NULL, false) AS has_qr, CASE WHEN s.has_qr
  AND file_id IS NOT NULL THEN qr_payload ELSE '' END AS payload, CASE WHEN file_id IS NULL THEN ''
  ELSE ocr_text END AS ocr_text FROM pick p JOIN image_signals s USING (unique_id)""",
    "image_renditions", "image_signals", more=_PICK))
def _attach_images(spark, sf_dir):
    m = I.pick_rendition(pictures(spark, sf_dir), CAP)
    out = I.attach_image_signals(m, decoded(spark, sf_dir))
    return out.select("message_id", "has_qr", F.array_join("qr_payloads", "|").alias("payload"),
                      "ocr_text")


@query("undecoded_images", with_views(
    "SELECT DISTINCT unique_id FROM pick WHERE file_id IS NOT NULL AND unique_id NOT IN "
    "(SELECT unique_id FROM image_signals WHERE has_qr)", "image_renditions", "image_signals",
    more=_PICK))
def _undecoded(spark, sf_dir):
    m = I.pick_rendition(pictures(spark, sf_dir), CAP)
    return I.undecoded_images(m, decoded(spark, sf_dir).filter("has_qr"))


@query("image_gates", with_views("""
SELECT message_id, s.has_qr AND file_size <= 2000000 AS has_qr, CASE WHEN s.has_qr AND
  file_size <= 2000000 THEN qr_payload ELSE '' END AS payload,
  CASE WHEN file_size <= 900000 THEN ocr_text ELSE '' END AS ocr_text
FROM image_renditions JOIN image_signals s USING (unique_id)""", "image_renditions",
    "image_signals"))
def _gates(spark, sf_dir):
    cfg = ModerationConfig(qr_max_bytes=2_000_000, ocr_max_bytes=900_000)
    m = load(spark, sf_dir, "image_renditions").join(decoded(spark, sf_dir), "unique_id")
    out = I.image_gates(m.withColumn("image_bytes", F.col("file_size")), cfg)
    return out.select("message_id", "has_qr", F.array_join("qr_payloads", "|").alias("payload"),
                      "ocr_text")


# --- all together ----------------------------------------------------------------------------


def _reasons(tag, is_new, t):
    rows = UNION.replace("FROM g ", f"FROM g_{tag} ")
    return f"""
g_{tag} AS (SELECT * REPLACE ({is_new} AS is_new_member, {t} AS t) FROM g),
sum_{tag} AS (SELECT message_id, sum(p) AS p, string_agg(reason || ' (+' || CAST(p AS BIGINT) || ')',
  '; ' ORDER BY pos) AS why FROM (SELECT message_id, pos, hard * {t} + soft AS p, reason FROM ({rows}))
  GROUP BY 1)"""


_BLOCKED = ("EXISTS (SELECT 1 FROM blacklist x WHERE x.chat_id IN (m.chat_id, 0) AND "
            "x.entity_id = coalesce(m.sender_chat_id, m.user_id))")
_KEPT_FEATURES = FEATURES.replace("AS scan FROM messages)", "AS scan FROM kept)").replace(
    "JOIN username_whitelist w ON w.chat_id IN (c.chat_id, 0)),",
    "JOIN username_whitelist w ON w.chat_id IN (c.chat_id, 0)\n"
    "  UNION SELECT chat_id, lower(username) FROM admins),")
MODERATE = f"""
judged AS (SELECT m.*, {_BLOCKED} AS is_blocked FROM messages m),
kept AS (SELECT m.* REPLACE (is_forward AND NOT (sender_chat_id IS NULL AND NOT is_blocked AND EXISTS (
    SELECT 1 FROM forward_whitelist w WHERE w.chat_id IN (m.chat_id, 0) AND w.user_id = m.user_id))
    AS is_forward)
  FROM judged m WHERE NOT is_automatic_forward
    AND coalesce(sender_chat_id <> chat_id AND sender_chat_id <> linked_chat_id, TRUE)
    AND (sender_chat_id IS NOT NULL OR NOT (user_is_bot OR user_id = 6
      OR user_id IN (SELECT user_id FROM bot_admins)
      OR EXISTS (SELECT 1 FROM admins a WHERE a.chat_id = m.chat_id AND a.user_id = m.user_id)))
    AND chat_id IN (SELECT chat_id FROM admin_status WHERE known)
    AND (is_blocked OR sender_chat_id IS NOT NULL OR NOT EXISTS (SELECT 1 FROM members x
      WHERE x.trusted AND x.chat_id = m.chat_id AND x.user_id = m.user_id))),
{_KEPT_FEATURES.strip()},
g AS (SELECT f.*, length(regexp_replace(body, '[^A-Za-z]', '', 'g')) AS latin,
  length(regexp_replace(lower(body), '[^авсеѕһіјкмнортухԁɡναβεικορτυχϲ]', '', 'g')) AS fakes,
  {NORM_OF_TEXT} AS n FROM f),
{_reasons('new', 'TRUE', 3)}, {_reasons('old', 'FALSE', 5)},
{BANNED_VIEWS.strip()},
asked AS (SELECT message_id, {BENIGN_SQL} AS asks FROM g),
pts AS (SELECT m.message_id, m.chat_id, m.user_id, m.sender_chat_id, m.ts_s, coalesce(a.p, 0) AS p_new,
  coalesce(b.p, 0) AS p_old, coalesce(a.why, '') AS why_new, coalesce(b.why, '') AS why_old,
  CASE WHEN is_blocked THEN 'blocked_sender' WHEN NOT asks AND hits IS NOT NULL THEN
    'banned_phrase: ' || array_to_string(hits[1:3], ', ') END AS forced
  FROM kept m JOIN asked USING (message_id) LEFT JOIN sum_new a USING (message_id)
  LEFT JOIN sum_old b USING (message_id) LEFT JOIN banned USING (message_id)),
ev AS (SELECT *, row_number() OVER (PARTITION BY chat_id, user_id ORDER BY ts_s, is_msg, id) AS rn
  FROM (SELECT chat_id, user_id, ts_s, 1 AS is_msg, message_id AS id, p_new, p_old, forced FROM pts
    WHERE sender_chat_id IS NULL
    UNION ALL SELECT chat_id, user_id, ts_s, 0, id, 0, 0, NULL FROM joins
    UNION ALL SELECT chat_id, 1 + user_id % 37, ts_s, 2, id, 0, 0, NULL FROM offences)),
fold AS (
  SELECT k.chat_id, k.user_id, CAST(0 AS BIGINT) AS rn, x.first_seen, coalesce(msg_count, 0) AS cnt,
    CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS message_id, FALSE AS is_new,
    CAST(0 AS BIGINT) AS prior, FALSE AS spam
  FROM (SELECT DISTINCT chat_id, user_id FROM ev) k LEFT JOIN members x USING (chat_id, user_id)
  UNION ALL
  SELECT chat_id, user_id, rn, CASE WHEN spam THEN NULL ELSE fs END, CASE WHEN spam THEN 0 ELSE cnt END,
    prior + CASE WHEN spam OR is_msg = 2 THEN 1 ELSE 0 END, id, is_new, prior, spam
  FROM (SELECT *, is_msg = 1 AND (forced IS NOT NULL OR score >= CASE WHEN is_new THEN 3 ELSE 5 END) AS spam
    FROM (SELECT *, CASE WHEN is_new THEN p_new ELSE p_old END + CASE WHEN
        CASE WHEN is_new THEN p_new ELSE p_old END > 0 THEN least(2 * prior, 4) ELSE 0 END AS score
      FROM (SELECT *, coalesce(ts_s - fs < 86400, FALSE) OR cnt <= 3 AS is_new
        FROM (SELECT e.*, CASE WHEN is_msg = 2 THEN f.first_seen ELSE coalesce(f.first_seen, e.ts_s) END
            AS fs, f.cnt + CASE WHEN is_msg = 1 THEN 1 ELSE 0 END AS cnt, f.n AS prior
          FROM fold f JOIN ev e ON e.chat_id = f.chat_id AND e.user_id = f.user_id
            AND e.rn = f.rn + 1))))),
found AS (SELECT message_id, is_new, prior FROM fold WHERE spam
  UNION ALL SELECT message_id, FALSE, CAST(0 AS BIGINT) FROM pts
    WHERE sender_chat_id IS NOT NULL AND (forced IS NOT NULL OR p_old >= 5)),
told AS (SELECT p.*, is_new, prior, CASE WHEN is_new THEN p_new ELSE p_old END AS base,
  CASE WHEN is_new THEN why_new ELSE why_old END AS why FROM found JOIN pts p USING (message_id))"""
_MODERATED = """
SELECT message_id, chat_id, coalesce(sender_chat_id, user_id) AS offender_id, is_new,
  prior AS prior_offences, CAST(CASE WHEN forced IS NOT NULL THEN 9999
    ELSE base + CASE WHEN base > 0 THEN least(2 * prior, 4) ELSE 0 END END AS BIGINT) AS score,
  CASE WHEN forced IS NOT NULL THEN forced WHEN base > 0 AND prior > 0 THEN why ||
    '; prior_offences: ' || prior || ' (+' || least(2 * prior, 4) || ')' ELSE why END AS reasons,
  'ban' AS action, CAST(NULL AS BIGINT) AS until FROM told"""


@query("moderate", with_views(
    _MODERATED, *FEATURE_SOURCES, "keyword_blacklist", "blacklist", "forward_whitelist", "members",
    "bot_admins", "admins", "admin_status", "joins", "offences", more=MODERATE, recursive=True))
def _moderate(spark, sf_dir):
    names = (*LISTS, "keyword_blacklist", "blacklist", "forward_whitelist", "members",
             "bot_admins")
    out = moderate(messages(spark, sf_dir), lists_of(spark, sf_dir, *names),
                   load(spark, sf_dir, "managed_chats"), load(spark, sf_dir, "admins"),
                   load(spark, sf_dir, "admin_status"), CFG, joins=load(spark, sf_dir, "joins"),
                   offences=past_offences(spark, sf_dir), owners=(6,))
    return A.resolve_action(out, CFG).select(
        "message_id", "chat_id", "offender_id", "is_new", "prior_offences",
        F.col("verdict.score").cast("bigint").alias("score"),
        F.array_join("verdict.reasons", "; ").alias("reasons"), "action", "until")


# --- bans carried to the sender's other chats -------------------------------------------------

#: One fold per sender over all chats (1 to 5): lists hold, per chat, first sight, messages, offences, and
#: the second of a carried ban that has not been applied yet.
_ACROSS = REPLAY[:REPLAY.index("ev AS (SELECT")] + """
ev AS (SELECT e.*, row_number() OVER (PARTITION BY e.user_id ORDER BY ts_s, is_msg, id, e.chat_id) AS rn,
    coalesce(exempt, []) AS exempt
  FROM (SELECT chat_id, user_id, ts_s, 1 AS is_msg, message_id AS id, p_new, p_old, mode FROM pts
    WHERE sender_chat_id IS NULL
    UNION ALL SELECT chat_id, user_id, ts_s, 0, id, 0, 0, NULL FROM joins
    UNION ALL SELECT chat_id, 1 + user_id % 37, ts_s, 2, id, 0, 0, NULL FROM offences) e
  LEFT JOIN (SELECT user_id, list(chat_id) AS exempt FROM admins GROUP BY 1) x ON x.user_id = e.user_id),
fold AS (
  SELECT k.user_id, CAST(0 AS BIGINT) AS rn, CAST([NULL, NULL, NULL, NULL, NULL] AS BIGINT[]) AS fs,
    CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS cnt, CAST([0, 0, 0, 0, 0] AS BIGINT[]) AS n,
    CAST([NULL, NULL, NULL, NULL, NULL] AS BIGINT[]) AS waits, CAST(NULL AS BIGINT) AS message_id,
    CAST(NULL AS BIGINT) AS ts_s, FALSE AS is_new, CAST(0 AS BIGINT) AS prior, CAST(0 AS BIGINT) AS score, FALSE AS spam
  FROM (SELECT DISTINCT user_id FROM ev) k
  UNION ALL
  SELECT user_id, rn,
    list_transform(range(1, 6), lambda c: CASE WHEN c = chat_id THEN CASE WHEN banned THEN NULL ELSE fs1 END
      WHEN banned AND NOT list_contains(exempt, c) AND waits[c] < ts_s THEN NULL ELSE fs[c] END),
    list_transform(range(1, 6), lambda c: CASE WHEN c = chat_id THEN CASE WHEN banned THEN 0 ELSE cnt1 END
      WHEN banned AND NOT list_contains(exempt, c) AND waits[c] < ts_s THEN 0 ELSE cnt[c] END),
    list_transform(range(1, 6), lambda c: n[c] + CASE WHEN c = chat_id AND (spam OR is_msg = 2) THEN 1 ELSE 0 END),
    list_transform(range(1, 6), lambda c: CASE WHEN c = chat_id THEN CASE WHEN waits[c] < ts_s THEN NULL ELSE waits[c] END
      WHEN banned AND NOT list_contains(exempt, c) THEN ts_s ELSE waits[c] END),
    id, ts_s, is_new, prior, score, spam
  FROM (SELECT *, spam AND mode = 'ban' AS banned
    FROM (SELECT *, is_msg = 1 AND score >= CASE WHEN is_new THEN 3 ELSE 5 END AS spam
    FROM (SELECT *, CAST(CASE WHEN is_new THEN p_new ELSE p_old END + CASE WHEN
        CASE WHEN is_new THEN p_new ELSE p_old END > 0 THEN least(2 * prior, 4) ELSE 0 END AS BIGINT) AS score
      FROM (SELECT *, coalesce(ts_s - fs1 < 86400, FALSE) OR cnt1 <= 3 AS is_new
        FROM (SELECT e.*, f.fs, f.cnt, f.n, f.waits, f.n[e.chat_id] AS prior,
            CASE WHEN is_msg = 2 THEN CASE WHEN waits[e.chat_id] < e.ts_s THEN NULL ELSE f.fs[e.chat_id] END
              ELSE coalesce(CASE WHEN waits[e.chat_id] < e.ts_s THEN NULL ELSE f.fs[e.chat_id] END, e.ts_s) END AS fs1,
            CASE WHEN waits[e.chat_id] < e.ts_s THEN 0 ELSE f.cnt[e.chat_id] END
              + CASE WHEN is_msg = 1 THEN 1 ELSE 0 END AS cnt1
          FROM fold f JOIN ev e ON e.user_id = f.user_id AND e.rn = f.rn + 1))))))"""


@query("replay_across_chats", with_views(USERS_AND_CHANNELS, *REPLAY_SOURCES, "admins",
                                         more=_ACROSS, recursive=True))
def _replay_across(spark, sf_dir):
    found = T.replay_across_chats(
        scored_both(spark, sf_dir, with_edits(prepared(spark, sf_dir))), load(spark, sf_dir, "joins"), CFG,
        load(spark, sf_dir, "managed_chats"), load(spark, sf_dir, "admins"), offences=past_offences(spark, sf_dir))
    return found.select("message_id", "ts_s", "offender_id", "is_new", "prior_offences",
                        F.col("verdict.score").cast("bigint").alias("score"))


# --- one call from messages to the log, with settings as they were at each message -----------


def _stored(key):
    return (f"(SELECT arg_max(value, (ts_s, id)) FROM settings_log l WHERE l.key = '{key}' "
            f"AND l.ts_s <= m.ts_s)")


def _on(name):
    return f"coalesce(CASE {_stored('cfg:' + name)} WHEN '1' THEN TRUE WHEN '0' THEN FALSE END, TRUE) AS {name}"


_SWITCHED = f"""
judged_at AS (SELECT m.*, {', '.join(map(_on, ('block_links', 'block_phones', 'scan_qr', 'block_forwards')))},
  lower(trim({_stored('action')})) AS stored, CAST({_stored('pause_until')} AS BIGINT) AS until_s FROM all_messages m),
messages AS (SELECT * REPLACE (has_qr AND scan_qr AS has_qr, CASE WHEN scan_qr THEN qr_payload END AS qr_payload),
  CASE WHEN stored IN ('ban', 'mute', 'delete', 'report') THEN stored ELSE 'ban' END AS mode
  FROM judged_at WHERE NOT coalesce(until_s > ts_s, FALSE))"""
_GATES = (  # what a switch that is off changes
    ("CAST(1 AS BIGINT) AS hard, CAST(0 AS BIGINT) AS soft, 'unknown_link: '",
     "CAST(CASE WHEN block_links THEN 1 ELSE 0 END AS BIGINT) AS hard, "
     "CAST(CASE WHEN block_links THEN 0 ELSE 2 END AS BIGINT) AS soft, 'unknown_link: '"),
    (f"CAST(1 AS BIGINT) AS hard, CAST(0 AS BIGINT) AS soft, {RULES_SQL['rule_phone'][3]} AS reason FROM g",
     "CAST(CASE WHEN block_phones THEN 1 ELSE 0 END AS BIGINT) AS hard, CAST(CASE WHEN block_phones THEN 0 ELSE 2 END "
     f"AS BIGINT) AS soft, CASE WHEN block_phones THEN {RULES_SQL['rule_phone'][3]} ELSE 'phone' END AS reason FROM g"),
    (f" WHERE {RULES_SQL['rule_phone'][0]}",
     f" WHERE {RULES_SQL['rule_phone'][0]} AND (block_phones OR norm <> '' OR len(urls) > 0)"),
    (FWD_WEAK, f"(NOT block_forwards OR {FWD_WEAK})"),
    ("m.sender_chat_id, m.ts_s, coalesce(a.p, 0)", "m.sender_chat_id, m.ts_s, m.mode, coalesce(a.p, 0)"),
    ("message_id AS id, p_new, p_old, forced FROM pts", "message_id AS id, p_new, p_old, forced, mode FROM pts"),
    ("0, id, 0, 0, NULL FROM joins", "0, id, 0, 0, NULL, NULL FROM joins"),
    ("2, id, 0, 0, NULL FROM offences", "2, id, 0, 0, NULL, NULL FROM offences"),
    ("CASE WHEN spam THEN NULL ELSE fs END, CASE WHEN spam THEN 0 ELSE cnt END",
     "CASE WHEN spam AND mode = 'ban' THEN NULL ELSE fs END, CASE WHEN spam AND mode = 'ban' THEN 0 ELSE cnt END"),
    ("'ban' AS action, CAST(NULL AS BIGINT) AS until FROM told",
     "CASE WHEN mode = 'mute' AND sender_chat_id IS NOT NULL THEN 'ban' ELSE mode END AS action, "
     "CAST(NULL AS BIGINT) AS until FROM told"),
)


def _with_settings(sql):
    sql = sql.replace("messages AS (", "all_messages AS (", 1)
    for old, new in _GATES:
        if old not in sql:
            raise ValueError(f"the query no longer says {old}")
        sql = sql.replace(old, new)
    return sql


def _gated(body):
    # the settings log is read by the messages, which therefore come after it
    views = ("settings_log", *FEATURE_SOURCES, "keyword_blacklist", "blacklist", "forward_whitelist", "members",
             "bot_admins", "admins", "admin_status", "joins", "offences")
    return _with_settings(with_views(body, *views, more=_SWITCHED.lstrip("\n") + ",\n" + MODERATE.strip(), recursive=True))


_LOGGED = f"""SELECT t.chat_id, offender_id AS user_id, all_messages.ts_s, score, t.action, t.reasons,
  left(coalesce(nullif(text, ''), caption, ''), 400) AS excerpt, left(sender_name, 80) AS name, message_id
FROM ({_MODERATED}) t JOIN all_messages USING (message_id)"""


def _to_log(spark, sf_dir):
    names = (*LISTS, "keyword_blacklist", "blacklist", "forward_whitelist", "members", "bot_admins")
    path = new_folder(spark, "offences")
    report = moderate_to_log(
        messages(spark, sf_dir), lists_of(spark, sf_dir, *names), load(spark, sf_dir, "managed_chats"),
        load(spark, sf_dir, "admins"), load(spark, sf_dir, "admin_status"), CFG, path, joins=load(spark, sf_dir, "joins"),
        offences=past_offences(spark, sf_dir), owners=(6,), settings_log=load(spark, sf_dir, "settings_log"))
    return path, report


@query("moderate_to_log", _gated(_LOGGED))
def _moderate_to_log(spark, sf_dir):
    path, _ = _to_log(spark, sf_dir)
    return read_offences(spark, path).select(
        "chat_id", "user_id", "ts_s", F.col("score").cast("bigint").alias("score"), "action", "reasons", "excerpt",
        "name", "message_id")


@query("moderate_with_settings", _gated(_MODERATED))
def _moderate_with_settings(spark, sf_dir):
    names = (*LISTS, "keyword_blacklist", "blacklist", "forward_whitelist", "members", "bot_admins")
    out = moderate(messages(spark, sf_dir), lists_of(spark, sf_dir, *names), load(spark, sf_dir, "managed_chats"),
                   load(spark, sf_dir, "admins"), load(spark, sf_dir, "admin_status"), CFG, joins=load(spark, sf_dir, "joins"),
                   offences=past_offences(spark, sf_dir), owners=(6,), settings_log=load(spark, sf_dir, "settings_log"))
    return A.resolve_action(out, CFG).select(
        "message_id", "chat_id", "offender_id", "is_new", "prior_offences",
        F.col("verdict.score").cast("bigint").alias("score"), F.array_join("verdict.reasons", "; ").alias("reasons"),
        "action", F.lit(None).cast("bigint").alias("until"))
