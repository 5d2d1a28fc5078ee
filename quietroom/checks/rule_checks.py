"""Dictionaries and rules: every rule on its own, then the whole score."""

from pyspark.sql import functions as F

from ..config import ModerationConfig
from ..functions import entities as E
from ..functions import phrases as P
from ..functions import rules as R
from ..functions.dictionaries import MEDIUM, STRONG, WEAK, squeezed_phrases
from ..functions.text import normalize, normalize_keep_accents
from ..operators import lists as L
from ..operators.scoring import (forced_reason, forced_verdict, is_benign_question,
                                 list_features, score_messages, text_features, without_texts)
from ..plans.moderate import attach_lists
from .base import joined, messages, q, query, sql_keep, sql_norm, with_views
from .entity_checks import (BODY_SQL, CRYPTO_SQL, EMOJI_SQL, INVITE_SQL, MONEY_SQL, QR_SQL, SCAN_SQL,
                            SPELLED_SQL, mentions_sql, path_sql, phones_sql, urls_sql)
from .text_checks import OBFUSCATION, QUESTION_SQL
from .views import load

CFG = ModerationConfig()
LISTS = ("chat_whitelist", "username_whitelist", "phone_whitelist")


def lists_of(spark, sf_dir, *names):
    return {n: load(spark, sf_dir, n) for n in names}


def sql_list(phrases):
    return "[" + ", ".join(q(p) for p in phrases) + "]"


def hits_sql(text, phrases):
    return f"list_filter({sql_list(phrases)}, lambda k: contains({text}, k))"


# --- dictionaries ---------------------------------------------------------------------

NORM_VIEW = f"n AS (SELECT message_id, {sql_norm(SCAN_SQL)} AS norm FROM messages)"
scannable = lambda: E.scannable_text(
    E.message_text("text", "caption"), "qr_payloads", "ocr_text")


def _norm(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", normalize(scannable()).alias("norm"))


_HITS = ", ".join(f"array_to_string(list_sort({hits_sql('norm', ps)}), '|') AS {t}" for t, ps in
                  (("strong", STRONG), ("medium", MEDIUM), ("weak", WEAK)))


@query("keyword_hits", with_views(f"SELECT message_id, {_HITS} FROM n", "messages",
                                  more=NORM_VIEW))
def _keyword_hits(spark, sf_dir):
    return _norm(spark, sf_dir).select("message_id", *[
        joined(P.keyword_hits("norm", t)).alias(t) for t in ("strong", "medium", "weak")])


def points_sql(text, phrases, weight):
    n = f"len({hits_sql(text, phrases)})"
    return f"CASE WHEN {n} > 0 THEN {weight} + least({n} - 1, 2) ELSE 0 END"


@query("keyword_points", with_views(
    f"SELECT message_id, CAST({points_sql('norm', STRONG, 3)} AS BIGINT) AS strong, "
    f"CAST({points_sql('norm', MEDIUM, 2)} AS BIGINT) AS medium, "
    f"CAST({points_sql('norm', WEAK, 1)} AS BIGINT) AS weak FROM n", "messages", more=NORM_VIEW))
def _keyword_points(spark, sf_dir):
    return _norm(spark, sf_dir).select("message_id", *[
        P.keyword_points(P.keyword_hits("norm", t), w).cast("bigint").alias(t)
        for t, w in (("strong", 3), ("medium", 2), ("weak", 1))])


def noisy_sql(norm):
    sq = f"replace({norm}, ' ', '')"
    return (f"CASE WHEN len({hits_sql(norm, STRONG)}) = 0 AND "
            f"len({hits_sql(sq, squeezed_phrases('strong'))}) > 0 THEN 3 "
            f"WHEN len({hits_sql(norm, MEDIUM)}) = 0 AND "
            f"len({hits_sql(sq, squeezed_phrases('medium'))}) > 0 THEN 2 ELSE 0 END")


@query("noisy_keyword_points", with_views(
    f"SELECT message_id, CAST({noisy_sql('norm')} AS BIGINT) AS points FROM n", "messages",
    more=NORM_VIEW))
def _noisy(spark, sf_dir):
    m = _norm(spark, sf_dir).withColumns({
        "s": P.keyword_hits("norm", "strong"), "m": P.keyword_hits("norm", "medium"),
        "squeezed": F.replace("norm", F.lit(" "), F.lit(""))})
    return m.select("message_id", P.noisy_keyword_points("s", "m", "squeezed")
                    .cast("bigint").alias("points"))


EVERYTHING = ("concat_ws(' ', nullif(text, ''), nullif(caption, ''), qr_payload, "
              "nullif(ocr_text, ''))")
BANNED_VIEWS = f"""
k AS (SELECT DISTINCT c.chat_id, phrase, {sql_keep('phrase')} AS kk, {sql_norm('phrase')} AS kp
      FROM managed_chats c JOIN keyword_blacklist w ON w.chat_id IN (c.chat_id, 0)),
t AS (SELECT message_id, chat_id, {sql_keep(EVERYTHING)} AS keep FROM messages),
banned AS (SELECT message_id, list_sort(list(DISTINCT phrase)) AS hits FROM t JOIN k USING (chat_id)
      WHERE contains(keep, kk) OR contains(keep, kp)
        OR contains(replace(keep, ' ', ''), replace(kk, ' ', ''))
        OR contains(replace(keep, ' ', ''), replace(kp, ' ', '')) GROUP BY 1)"""


@query("banned_phrase_hits", with_views(
    "SELECT message_id, array_to_string(hits, '|') AS hits FROM banned", "messages",
    "managed_chats", "keyword_blacklist", more=BANNED_VIEWS))
def _banned(spark, sf_dir, phrases="keyword_blacklist", each=1):
    m = messages(spark, sf_dir, each)
    m = m.withColumn("keep_text", normalize_keep_accents(F.concat_ws(
        " ", F.nullif("text", F.lit("")), F.nullif("caption", F.lit("")), "qr_payloads",
        F.nullif("ocr_text", F.lit("")))))
    hits = L.with_banned_hits(m, load(spark, sf_dir, phrases))
    return hits.filter(F.size("banned_hits") > 0).select(
        "message_id", joined("banned_hits").alias("hits"))


@query("banned_phrase_index", with_views(
    "SELECT message_id, array_to_string(hits, '|') AS hits FROM banned", "messages",
    "managed_chats", "text_phrases", more=BANNED_VIEWS.replace("keyword_blacklist", "text_phrases")))
def _banned_index(spark, sf_dir):
    return _banned(spark, sf_dir, "text_phrases", each=4)


BENIGN_SQL = (f"NOT (has_media OR has_buttons OR has_qr OR has_entities) AND "
              f"(contains(text, '?') OR {QUESTION_SQL})")


@query("question_exemption", with_views(
    f"SELECT message_id, {BENIGN_SQL} AS exempt FROM "
    f"(SELECT *, {sql_norm('text')} AS n FROM messages)", "messages"))
def _benign(spark, sf_dir):
    m = messages(spark, sf_dir)
    return m.select("message_id", is_benign_question().alias("exempt"))


# --- features in SQL ------------------------------------------------------------------

FEATURE_SOURCES = ("messages", "managed_chats", *LISTS)
FEATURES = f"""
b AS (SELECT *, {BODY_SQL} AS body, {SCAN_SQL} AS scan FROM messages),
f0 AS (SELECT *, {sql_norm('scan')} AS norm, {sql_norm('sender_name')} AS norm_name,
  {urls_sql('body')} AS urls, {mentions_sql('body')} AS handles, {phones_sql('scan')} AS phones
  FROM b),
all_urls AS (SELECT DISTINCT message_id, chat_id, unnest(urls) AS url FROM f0),
hosted AS (SELECT *, lower(regexp_extract(url, '(?i)^(?:[a-z][a-z0-9+.-]*://)?(?:www\\.)?([^/?#:]+)',
  1)) AS host, {path_sql('url')} AS path FROM all_urls),
domains AS (SELECT c.chat_id, lower(split_part(domain, '/', 1)) AS ehost,
  trim(lower(regexp_extract(domain, '^[^/]*/(.*)$', 1)), '/') AS epath
  FROM managed_chats c JOIN chat_whitelist w ON w.chat_id IN (c.chat_id, 0)),
unknown AS (SELECT * FROM hosted h WHERE NOT EXISTS (SELECT 1 FROM domains d
  WHERE d.chat_id = h.chat_id AND (h.host = d.ehost OR ends_with(h.host, '.' || d.ehost))
  AND (d.epath = '' OR h.path = d.epath OR starts_with(h.path, d.epath || '/')))),
host_l AS (SELECT message_id, list_sort(list(DISTINCT host)) AS hosts FROM hosted GROUP BY 1),
unk_l AS (SELECT message_id, list(DISTINCT url) AS unknown_urls, list(DISTINCT host) AS unknown_hosts,
  list_sort(list(DISTINCT CASE WHEN path = '' THEN host ELSE host || '/' || path END)) AS shown
  FROM unknown GROUP BY 1),
ats AS (SELECT DISTINCT c.chat_id, username FROM managed_chats c
  JOIN username_whitelist w ON w.chat_id IN (c.chat_id, 0)),
at_l AS (SELECT message_id, list_sort(list(handle)) AS unknown_ats FROM
  (SELECT message_id, chat_id, unnest(handles) AS handle FROM f0) x
  WHERE NOT EXISTS (SELECT 1 FROM ats a WHERE a.chat_id = x.chat_id AND a.username = x.handle)
  GROUP BY 1),
tels AS (SELECT DISTINCT c.chat_id, phone FROM managed_chats c
  JOIN phone_whitelist w ON w.chat_id IN (c.chat_id, 0)),
tel_l AS (SELECT message_id, list_sort(list(tel)) AS unknown_tels FROM
  (SELECT message_id, chat_id, unnest(phones) AS tel FROM f0) x
  WHERE NOT EXISTS (SELECT 1 FROM tels a WHERE a.chat_id = x.chat_id AND a.phone = x.tel)
  GROUP BY 1),
f AS (SELECT f0.*, coalesce(hosts, []) AS hosts, coalesce(unknown_urls, []) AS unknown_urls,
  coalesce(unknown_hosts, []) AS unknown_hosts, coalesce(shown, []) AS shown,
  coalesce(unknown_ats, []) AS unknown_ats, coalesce(unknown_tels, []) AS unknown_tels,
  CASE WHEN is_new_member THEN 3 ELSE 5 END AS t
  FROM f0 LEFT JOIN host_l USING (message_id) LEFT JOIN unk_l USING (message_id)
  LEFT JOIN at_l USING (message_id) LEFT JOIN tel_l USING (message_id))"""


def _first(items, n, prefix=""):
    pick = f"list_sort({items})[1:{n}]"
    if prefix:
        pick = f"list_transform({pick}, lambda x: '{prefix}' || x)"
    return f"array_to_string({pick}, ', ')"


FWD_WEAK = "(has_media AND NOT has_qr)"
SHORT = sql_list(R.SHORTENERS)
RISKY = sql_list(R.RISKY_TLDS)
TITLE = (r"regexp_extract(' ' || norm_name || ' ', '(?:^|\s)(" + "|".join(R.STAFF_TITLES)
         + r")(?:\s|$)', 1)")
CAPS = (r"length(regexp_replace(body, '\P{L}', '', 'g')) >= 25 AND "
        r"length(regexp_replace(body, '\P{Lu}', '', 'g')) > "
        r"0.7 * length(regexp_replace(body, '\P{L}', '', 'g'))")
EMOJIS = f"length(regexp_replace(body, '{EMOJI_SQL}', '', 'g'))"
OBF = OBFUSCATION.replace("(text,", "(body,")


def kw_rule(tier, phrases, weight):
    hits = hits_sql("norm", phrases)
    return (f"len({hits}) > 0", "0", points_sql("norm", phrases, weight),
            f"'{tier}_phrases: ' || {_first(hits, 3)}")


# name -> (fires, hard, soft, reason), in the order of the score
RULES_SQL = {
    "strong": kw_rule("strong", STRONG, 3),
    "medium": kw_rule("medium", MEDIUM, 2),
    "weak": kw_rule("weak", WEAK, 1),
    "noisy": (f"{noisy_sql('norm')} > 0", "0", noisy_sql("norm"), "'noisy_phrases'"),
    "rule_forward": ("is_forward", f"CASE WHEN {FWD_WEAK} THEN 0 ELSE 1 END",
                     f"CASE WHEN {FWD_WEAK} THEN 1 ELSE 0 END", """concat_ws(': ', 'forward',
  CASE forward_origin WHEN 'user' THEN 'người dùng' WHEN 'hidden_user' THEN
  'người dùng ẩn danh' WHEN 'chat' THEN 'nhóm khác' WHEN 'channel' THEN 'kênh khác'
  WHEN 'story' THEN 'nguồn khác' END)"""),
    "rule_channel_sender": ("from_channel", "1", "0", "'channel_sender'"),
    "rule_unknown_link": ("len(unknown_urls) > 0", "1", "0",
                          f"'unknown_link: ' || {_first('shown', 3)}"),
    "rule_shortener": (f"list_has_any(hosts, {SHORT})", "0", "3", "'shortener'"),
    "rule_risky_tld": (f"list_has_any(list_transform(hosts, lambda h: string_split(h, '.')[-1]), "
                       f"{RISKY})", "0", "2", "'risky_tld'"),
    "rule_invite": (f"regexp_matches(body, '{INVITE_SQL}')", "0", "3", "'invite_link'"),
    "rule_obfuscated_url": (f"len(hosts) = 0 AND regexp_matches(body, '{SPELLED_SQL}')", "0", "3",
                            "'spelled_out_link'"),
    "qr_code": ("has_qr AND qr_payload IS NOT NULL", "0", "2", "'qr_code'"),
    "qr_newcomer": ("has_qr AND qr_payload IS NOT NULL AND is_new_member", "0", "2",
                    "'qr_newcomer'"),
    "rule_qr_payload": (f"qr_payload IS NOT NULL AND {QR_SQL} <> 'other'",
                        f"CASE WHEN {QR_SQL} = 'allowed_link' THEN 0 ELSE 1 END",
                        f"CASE WHEN {QR_SQL} = 'allowed_link' THEN 1 ELSE 0 END",
                        f"""CASE {QR_SQL} WHEN 'unknown_link' THEN 'qr_unknown_link: ' ||
  lower(regexp_extract(qr_payload, '^https?://([^/?#:]+)', 1)) ELSE 'qr_' || {QR_SQL} END"""),
    "rule_mentions": ("len(unknown_ats) > 0 OR len(handles) >= 3",
                      "CASE WHEN len(unknown_ats) > 0 THEN 1 ELSE 0 END",
                      "CASE WHEN len(unknown_ats) > 0 THEN 0 ELSE 2 END",
                      f"CASE WHEN len(unknown_ats) > 0 THEN 'unknown_mention: ' || "
                      f"{_first('unknown_ats', 3, '@')} ELSE 'mentions: ' || len(handles) END"),
    "rule_crypto": (f"regexp_matches(scan, '{CRYPTO_SQL}')", "1", "0", "'crypto_address'"),
    "rule_phone": ("len(unknown_tels) > 0", "1", "0",
                   f"'unknown_phone: ' || {_first('unknown_tels', 2)}"),
    "rule_money": (f"regexp_matches(body, '{MONEY_SQL}')", "0", "1", "'money_amount'"),
    "rule_fake_admin": (f"{TITLE} <> ''", "1", "0", f"'fake_admin: ' || {TITLE}"),
    "rule_obfuscation": (f"({OBF}) > 0", "0", OBF, "'obfuscation'"),
    "rule_caps": (CAPS, "0", "1", "'capitals'"),
    "rule_emoji": (f"{EMOJIS} >= 5", "0", f"CASE WHEN {EMOJIS} >= 8 THEN 2 ELSE 1 END",
                   f"'emoji: ' || {EMOJIS}"),
    "rule_story": ("has_story", "1", "0", "'story'"),
    "rule_buttons": ("has_buttons", "0", "3", "'buttons'"),
    "rule_via_bot": ("via_bot", "0", "1", "'via_bot'"),
    "rule_new_member_link": ("is_new_member AND (len(unknown_hosts) > 0 OR is_forward)", "0", "1",
                             "'newcomer_link'"),
    "rule_no_username_link": ("is_new_member AND NOT has_username AND len(urls) > 0", "0", "1",
                              "'no_username_link'"),
}
ORDER = list(RULES_SQL)
KEYWORD_RULES = ("strong", "medium", "weak", "noisy")
MORE = FEATURES + """,
g AS (SELECT f.*, length(regexp_replace(body, '[^A-Za-z]', '', 'g')) AS latin,
  length(regexp_replace(lower(body), '[^авсеѕһіјкмнортухԁɡναβεικορτυχϲ]', '', 'g')) AS fakes FROM f)"""


def rule_sql(name, asks="FALSE"):
    fires, hard, soft, reason = RULES_SQL[name]
    if name in KEYWORD_RULES:
        fires = f"({fires}) AND NOT ({asks})"
    return (f"SELECT message_id, CAST({hard} AS BIGINT) AS hard, CAST({soft} AS BIGINT) AS soft, "
            f"{reason} AS reason FROM g WHERE {fires}")


def prepared(spark, sf_dir):
    return messages(spark, sf_dir).withColumn("forward_label", E.forward_label("forward_origin"))


def attach(spark, sf_dir):
    lists = lists_of(spark, sf_dir, *LISTS)
    return lambda features: attach_lists(features, lists)


#: What looking entities up needs of the features; a rule names what it needs besides, as features that are
#: looked up by tables are staged, and a staged column is computed whether it is read again or not.
LOOKED_UP = ("message_id", "chat_id", "urls", "handles", "phones", "qr_payloads")


def _rule(name, build, lists=None):
    def run(spark, sf_dir):
        m = prepared(spark, sf_dir).drop("has_entities")  # no question exemption
        f = text_features(m, CFG)
        if lists is not None:
            f = list_features(attach(spark, sf_dir)(without_texts(f).select(*LOOKED_UP, *lists)), CFG)
        f = f.select("message_id", build().alias("r")).filter("r IS NOT NULL")
        return f.select("message_id", F.col("r.hard").cast("bigint").alias("hard"),
                        F.col("r.soft").cast("bigint").alias("soft"), "r.reason")
    query(name, with_views(rule_sql(name), *FEATURE_SOURCES, more=MORE))(run)


NEW = "is_new_member"
_rule("rule_forward", lambda: R.rule_forward(
    "is_forward", "forward_label", "has_media", "has_qr", NEW, CFG))
_rule("rule_channel_sender", lambda: R.rule_channel_sender("from_channel", CFG))
_rule("rule_unknown_link", lambda: R.rule_unknown_link("unknown_urls", NEW, CFG), (NEW,))
_rule("rule_shortener", lambda: R.rule_shortener("hosts"))
_rule("rule_risky_tld", lambda: R.rule_risky_tld("hosts"))
_rule("rule_invite", lambda: R.rule_invite("body"))
_rule("rule_obfuscated_url", lambda: R.rule_obfuscated_url("body", "hosts"))
_rule("rule_mentions", lambda: R.rule_mentions("handles", "unknown_mentions", CFG), ())
_rule("rule_crypto", lambda: R.rule_crypto("scannable"))
_rule("rule_phone", lambda: R.rule_phone(
    "unknown_phones", "has_words", "urls", CFG), ("has_words",))
_rule("rule_money", lambda: R.rule_money("body"))
_rule("rule_fake_admin", lambda: R.rule_fake_admin("norm_name", "is_real_admin", CFG))
_rule("rule_obfuscation", lambda: R.rule_obfuscation("body"))
_rule("rule_caps", lambda: R.rule_caps("body"))
_rule("rule_emoji", lambda: R.rule_emoji("body"))
_rule("rule_story", lambda: R.rule_story("has_story"))
_rule("rule_buttons", lambda: R.rule_buttons("has_buttons"))
_rule("rule_via_bot", lambda: R.rule_via_bot("via_bot"))
_rule("rule_new_member_link", lambda: R.rule_new_member_link(NEW, "unknown_hosts", "is_forward"),
      (NEW, "is_forward"))
_rule("rule_no_username_link", lambda: R.rule_no_username_link(NEW, "has_username", "urls"))


# a picture may hold several codes: the message's own, one with a link of its own, a note
_CODES = ("unnest([qr_payload, 'https://seat' || message_id || '.example.net/menu', 'Table ' || message_id, "
          "'https://docs.example.org/p/' || message_id])")
_QR_FIRES, _QR_HARD, _QR_SOFT, _QR_REASON = RULES_SQL["rule_qr_payload"]


@query("rule_qr_payload", with_views(
    f"SELECT message_id, CAST({_QR_HARD} AS BIGINT) AS hard, CAST({_QR_SOFT} AS BIGINT) AS soft, {_QR_REASON} AS reason "
    f"FROM (SELECT message_id, {_CODES} AS qr_payload FROM messages WHERE has_qr) WHERE {_QR_FIRES}", "messages"))
def _qr_payload(spark, sf_dir):
    number = F.col("message_id").cast("string")
    codes = F.array(F.concat(F.lit("https://seat"), number, F.lit(".example.net/menu")), F.concat(F.lit("Table "), number),
                    F.concat(F.lit("https://docs.example.org/p/"), number))
    m = messages(spark, sf_dir).filter("has_qr").withColumn("qr_payloads", F.concat("qr_payloads", codes))
    m = attach(spark, sf_dir)(without_texts(text_features(m, CFG)).select(*LOOKED_UP))
    fired = list_features(m, CFG).select("message_id", F.explode(R.rule_qr_payload("qr_payloads", "allow_domains")).alias("r"))
    return fired.filter("r IS NOT NULL").select("message_id", F.col("r.hard").cast("bigint").alias("hard"),
                                                F.col("r.soft").cast("bigint").alias("soft"), "r.reason")


@query("rule_qr_present", with_views(
    "SELECT message_id, CAST(CASE WHEN is_new_member THEN 4 ELSE 2 END AS BIGINT) AS points "
    "FROM messages WHERE has_qr AND qr_payload IS NOT NULL", "messages"))
def _qr_present(spark, sf_dir):
    seen, new = R.rule_qr_present("has_qr", "qr_payloads", NEW)
    m = messages(spark, sf_dir).select("message_id", seen.alias("a"), new.alias("b"))
    return m.filter("a IS NOT NULL").select("message_id", (
        F.col("a.soft") + F.coalesce("b.soft", F.lit(0))).cast("bigint").alias("points"))


@query("threshold", with_views(
    "SELECT message_id, CAST(CASE WHEN is_new_member THEN 3 ELSE 5 END AS BIGINT) AS threshold "
    "FROM messages", "messages"))
def _threshold(spark, sf_dir):
    return messages(spark, sf_dir).select(
        "message_id", R.threshold(NEW, CFG).cast("bigint").alias("threshold"))


@query("rule_prior_offences", with_views(
    "SELECT message_id, CASE WHEN message_id % 6 > 0 THEN least(prior_offences * 2, 4) ELSE 0 "
    "END AS points FROM messages", "messages"))
def _prior(spark, sf_dir):
    return messages(spark, sf_dir).select("message_id", R.prior_points(
        F.col("message_id") % 6, "prior_offences").cast("bigint").alias("points"))


# --- the whole score --------------------------------------------------------------------

UNION = "\nUNION ALL ".join(
    f"SELECT message_id, {i} AS pos, hard, soft, reason FROM ({rule_sql(n, BENIGN_SQL)})"
    for i, n in enumerate(ORDER))
NORM_OF_TEXT = sql_norm("text")
SCORE_VIEWS = FEATURES + f""",
g AS (SELECT f.*, length(regexp_replace(body, '[^A-Za-z]', '', 'g')) AS latin,
  length(regexp_replace(lower(body), '[^авсеѕһіјкмнортухԁɡναβεικορτυχϲ]', '', 'g')) AS fakes,
  {sql_norm('text')} AS n FROM f),
fired AS ({UNION}),
pts AS (SELECT r.message_id, pos, hard * t + soft AS p, reason FROM fired r JOIN f USING (message_id)),
sums AS (SELECT message_id, sum(p) AS base, string_agg(reason || ' (+' || CAST(p AS BIGINT) || ')',
  '; ' ORDER BY pos) AS why FROM pts GROUP BY 1),
scores AS (SELECT f.message_id, chat_id, CAST(coalesce(base, 0) + CASE WHEN base > 0 THEN
  least(2 * prior_offences, 4) ELSE 0 END AS BIGINT) AS score, CAST(t AS BIGINT) AS threshold,
  concat_ws('; ', why, CASE WHEN base > 0 AND prior_offences > 0 THEN 'prior_offences: ' ||
  prior_offences || ' (+' || least(2 * prior_offences, 4) || ')' END) AS reasons
  FROM f LEFT JOIN sums USING (message_id))"""


def scored(spark, sf_dir):
    return score_messages(prepared(spark, sf_dir), CFG, attach(spark, sf_dir))


@query("score_messages", with_views(
    "SELECT message_id, score, threshold, reasons, score >= threshold AS is_spam FROM scores",
    *FEATURE_SOURCES, more=SCORE_VIEWS))
def _score(spark, sf_dir):
    return scored(spark, sf_dir).select(
        "message_id", F.col("verdict.score").cast("bigint").alias("score"),
        F.col("verdict.threshold").cast("bigint").alias("threshold"),
        F.array_join("verdict.reasons", "; ").alias("reasons"), "verdict.is_spam")


@query("spam_per_chat", with_views(
    "SELECT chat_id, count(*) AS messages, count(*) FILTER (score >= threshold) AS spam "
    "FROM scores GROUP BY 1", *FEATURE_SOURCES, more=SCORE_VIEWS))
def spam_per_chat(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("chat_id").agg(
        F.count("*").alias("messages"), F.count_if("verdict.is_spam").alias("spam"))


BLOCK_VIEW = """bl AS (SELECT m.message_id, EXISTS (SELECT 1 FROM blacklist b WHERE
  b.chat_id IN (m.chat_id, 0) AND b.entity_id = coalesce(m.sender_chat_id, m.user_id)) AS is_blocked
  FROM messages m)"""


@query("forced_verdict", with_views("""
SELECT message_id, CAST(9999 AS BIGINT) AS score, CAST(1 AS BIGINT) AS threshold,
  CASE WHEN is_blocked THEN 'blocked_sender' ELSE 'banned_phrase: ' ||
  array_to_string(hits[1:3], ', ') END AS reason
FROM bl LEFT JOIN banned USING (message_id) WHERE is_blocked OR hits IS NOT NULL""",
    "messages", "managed_chats", "keyword_blacklist", "blacklist",
    more=BANNED_VIEWS + ",\n" + BLOCK_VIEW))
def _forced(spark, sf_dir):
    m = L.blocked_sender(messages(spark, sf_dir), load(spark, sf_dir, "blacklist"))
    m = m.withColumn("keep_text", normalize_keep_accents(F.concat_ws(
        " ", F.nullif("text", F.lit("")), F.nullif("caption", F.lit("")), "qr_payloads",
        F.nullif("ocr_text", F.lit("")))))
    m = L.with_banned_hits(m, load(spark, sf_dir, "keyword_blacklist"), skip=F.col("is_blocked"))
    m = m.withColumn("why", forced_reason("is_blocked", "banned_hits")).filter("why IS NOT NULL")
    v = m.select("message_id", forced_verdict(F.col("why")).alias("v"))
    return v.select("message_id", F.col("v.score").cast("bigint").alias("score"),
                    F.col("v.threshold").cast("bigint").alias("threshold"),
                    F.col("v.reasons")[0].alias("reason"))
