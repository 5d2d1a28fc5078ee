"""The whole way from messages to offences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import GLOBAL, ModerationConfig
from ..functions import entities as E
from ..functions.text import normalize_keep_accents
from ..operators import lists as L
from ..operators.scoring import (forced_reason, score_both, text_features, with_defaults,
                                 without_texts)
from ..operators.actions import resolve_action
from ..operators.state import as_of, at_each_message, exclude_paused, replay_across_chats, replay_verdicts, switches_as_of
from ..sources.storage import staged
from ..sources.tables import write_offences
from .reports import moderation_report, offence_rows

Lists = dict[str, DataFrame]


ENTITY_LISTS = ("chat_whitelist", "username_whitelist", "phone_whitelist")


def attach_lists(features: DataFrame, lists: Lists, admins: DataFrame | None = None,
                 own_username: str = "") -> DataFrame:
    """Add what the chat allows (domains, mentions, phones) to text features.

    A handful of entries, admins counted in, is broadcast as one bundle per scope.  With longer
    lists each message, numbered, gets only the entries that concern it: its links, mentions
    and phones are looked up by equi-joins, and those found allowed come back as its own short
    lists.  Only messages that hold any of them are shuffled, and never their texts.
    """
    entries = staged(L.scoped_entries(lists, admins, own_username, ENTITY_LISTS))
    names = [L.BUNDLE[n][1] for n in ENTITY_LISTS]
    if L.is_small(entries, L.MAX_BUNDLE_ENTRIES):
        bundles = entries.groupBy("scope").agg(*[
            F.collect_set(F.when(F.col("list") == n, F.col("value"))).alias(n) for n in names])
        everywhere = F.col("scope") == GLOBAL
        own = bundles.filter(~everywhere).select(F.col("scope").alias("_scope"), *[F.col(n).alias(f"_o_{n}") for n in names])
        shared = bundles.filter(everywhere).select(*[F.col(n).alias(f"_g_{n}") for n in names])
        both = (features.join(F.broadcast(own), F.col("chat_id") == F.col("_scope"), "left")
                .join(F.broadcast(shared), F.lit(True), "left"))
        return both.select(*features.columns, *[F.array_union(
            F.coalesce(f"_o_{n}", E.no_strings()), F.coalesce(f"_g_{n}", E.no_strings())).alias(n) for n in names])
    rows = staged(features.withColumn("_row", F.monotonically_increasing_id()))
    allowed = allowed_entities(rows, entries)
    some = (F.size("urls") + F.size("handles") + F.size("phones") + F.size("qr_payloads")) > 0
    concerned = rows.filter(some).join(allowed, "_row", "left")
    return concerned.unionByName(rows.filter(~some), allowMissingColumns=True).drop("_row")


def allowed_entities(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Per message number ``_row``, its own links, mentions and phones that its chat allows."""

    def tagged(kind, values):
        return F.transform(values, lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("v")))

    links = F.array_union("urls", F.flatten(F.transform("qr_payloads", E.qr_links)))
    every = rows.select("_row", "chat_id", F.explode(F.concat(
        tagged("allow_domains", links), tagged("allow_usernames", F.col("handles")),
        tagged("allow_phones", F.col("phones")))).alias("e"))
    every = staged(every.select("_row", "chat_id", "e.kind", "e.v"))

    # each link and name of a chat is looked up once, however often it is posted
    distinct = every.select("chat_id", "kind", "v").distinct()
    parts = E.split_url("url")
    domains = entries.filter("list = 'allow_domains'").select(
        F.col("scope").alias("chat_id"), F.col("value").alias("domain"))
    good_urls = L.url_allowed(distinct.filter("kind = 'allow_domains'").select("chat_id", F.col("v").alias("url")),
                              domains).filter("allowed").select(
        "chat_id", F.lit("allow_domains").alias("kind"), F.col("url").alias("v"),
        F.concat_ws("/", parts["host"], F.nullif(parts["path"], F.lit(""))).alias("shown"))
    known = entries.select("scope", F.col("list").alias("kind"), F.col("value").alias("v"))
    scoped = distinct.filter("kind <> 'allow_domains'").select(
        "chat_id", "kind", "v", F.explode(L.scopes()).alias("scope"))
    good = scoped.join(L.broadcast_if_small(known), ["scope", "kind", "v"], "left_semi").select(
        "chat_id", "kind", "v", F.col("v").alias("shown")).distinct().unionByName(good_urls)
    met = every.join(L.broadcast_if_small(staged(good)), ["chat_id", "kind", "v"])
    return met.groupBy("_row").agg(*[
        F.collect_set(F.when(F.col("kind") == L.BUNDLE[n][1], F.col("shown"))).alias(L.BUNDLE[n][1])
        for n in ENTITY_LISTS])


def scan(msgs: DataFrame, lists: Lists, chats: DataFrame, admins: DataFrame,
         admin_status: DataFrame, cfg: ModerationConfig, owners: tuple[int, ...] = (),
         settings_log: DataFrame | None = None, own_username: str = "") -> DataFrame:
    """Scored messages of everybody who is moderated, ready for ``replay_verdicts``.

    Cheap exemptions come first, so exempt messages never reach the text work.  With a
    ``settings_log``, the pause, the switches and the action hold as they were at each message.
    """
    m = L.exclude_exempt(msgs, admins, lists["bot_admins"], owners)
    if settings_log is not None:
        m = switches_as_of(exclude_paused(m, settings_log), settings_log, cfg)
        cfg = at_each_message(cfg)
    m = L.require_known_admins(m, admin_status)
    m = L.blocked_sender(m, lists["blacklist"])
    m = L.exclude_trusted(m, lists["members"]) if "members" in lists else m
    m = L.forward_exempt(m, lists["forward_whitelist"])
    m = with_defaults(m)
    m = m.withColumns({
        "is_forward": F.col("is_forward") & ~F.col("may_forward"),
        "forward_label": E.forward_label("forward_origin")})
    if settings_log is not None:
        qr, ocr = F.col("sw_scan_qr"), F.col("sw_scan_ocr")
        m = m.withColumns({"has_qr": F.col("has_qr") & qr,
                           "qr_payloads": F.when(qr, F.col("qr_payloads")).otherwise(E.no_strings()),
                           "ocr_text": F.when(ocr, F.col("ocr_text")).otherwise("")})
    m = text_features(m, cfg).withColumn("keep_text", normalize_keep_accents(F.concat_ws(
        " ", F.nullif("text", F.lit("")), F.nullif("caption", F.lit("")), "qr_payloads",
        F.nullif("ocr_text", F.lit("")))))
    m = L.with_banned_hits(m, lists["keyword_blacklist"], skip=F.col("is_question") | F.col("is_blocked"))
    m = m.withColumn("forced_reason", forced_reason("is_blocked", "banned_hits"))
    m = score_both(attach_lists(without_texts(m), lists, admins, own_username), cfg)
    action = F.lit(cfg.action)
    if settings_log is not None:
        m = as_of(m, settings_log.filter("key = 'action'"), "value", "_mode")
        mode = F.lower(E.strip_spaces("_mode"))
        action = F.when(mode.isin("ban", "mute", "delete", "report"), mode).otherwise(action)
    return m.withColumns({"action": action, "ban_all_groups": F.lit(cfg.ban_all_groups)}).select(
        "message_id", "chat_id", "user_id", "sender_chat_id", "ts_s", "signals_new",
        "signals_old", "forced_reason", "action", "ban_all_groups")


def moderate(msgs: DataFrame, lists: Lists, chats: DataFrame, admins: DataFrame,
             admin_status: DataFrame, cfg: ModerationConfig, joins: DataFrame | None = None,
             offences: DataFrame | None = None, settings_log: DataFrame | None = None,
             owners: tuple[int, ...] = (), own_username: str = "", carry_bans: bool = False) -> DataFrame:
    """Offences with verdicts: ``scan`` followed by ``replay_verdicts``.

    With ``carry_bans`` a ban also makes the sender's other chats forget them, within this replay.
    """
    scored = scan(msgs, lists, chats, admins, admin_status, cfg, owners, settings_log, own_username)
    if carry_bans:
        return replay_across_chats(scored, joins, cfg, chats, admins, lists.get("members"), offences)
    return replay_verdicts(scored, joins, cfg, lists.get("members"), offences)


def with_texts(found: DataFrame, msgs: DataFrame) -> DataFrame:
    """Give offences the texts and names of their messages back.

    Only messages that were found are looked at again: their keys, broadcast after counting, go to
    the texts.  A message that was delivered twice gives one of its copies.
    """
    key = ["chat_id", "message_id", "ts_s"]
    have = [c for c in ("text", "caption", "sender_name", "username", "channel_title") if c in msgs.columns]
    wanted = L.broadcast_if_small(staged(found.select(*key).distinct()))
    texts = msgs.join(wanted, key, "left_semi").groupBy(*key).agg(F.min(F.struct(*have)).alias("_m"))
    out = found.join(L.broadcast_if_small(staged(texts)), key, "left")
    given = {c: F.col(f"_m.{c}") if c in have else F.lit(None).cast("string")
             for c in ("text", "caption", "sender_name", "username", "channel_title")}
    return out.withColumns(given).drop("_m")


def moderate_to_log(msgs: DataFrame, lists: Lists, chats: DataFrame, admins: DataFrame,
                    admin_status: DataFrame, cfg: ModerationConfig, path: str, **more) -> DataFrame:
    """From messages to the offence log under ``path``, and a report row per offence.

    Takes what ``moderate`` takes.  Texts are left behind while verdicts are found, and only those
    of offences are fetched again.
    """
    found = staged(resolve_action(moderate(msgs, lists, chats, admins, admin_status, cfg, **more), cfg))
    told = staged(with_texts(found, msgs))
    write_offences(offence_rows(told), path)
    return moderation_report(told)
