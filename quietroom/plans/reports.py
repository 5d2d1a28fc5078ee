"""Reports over the offence log, the lists and the members."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import GLOBAL, ModerationConfig
from ..functions import entities as E
from ..functions.text import normalize_keep_accents
from ..operators.actions import service_kinds
from ..operators.lists import (blocked_sender, broadcast_if_small, effective_config,
                               forward_exempt, with_banned_hits)
from ..operators.scoring import score_messages, with_defaults
from ..operators.state import BANNING, DAY


def _banning() -> Column:
    return F.col("action").isin(*BANNING)


def chat_stats(offences: DataFrame, now: int) -> DataFrame:
    recent = F.col("ts_s") > now - DAY
    return offences.groupBy("chat_id").agg(
        F.count("*").alias("offences"), F.count_if(F.col("action") == "ban").alias("bans"),
        F.count_if(recent).alias("last_day"))


def recent_bans(offences: DataFrame, k: int = 10) -> DataFrame:
    return (offences.filter(_banning())
            .select("id", "chat_id", "user_id", "ts_s", "score", "reasons", "excerpt", "name")
            .orderBy(F.desc("ts_s"), F.desc("id")).limit(k))


def recent_ban_count(offences: DataFrame, now: int, seconds: int) -> DataFrame:
    return offences.filter(_banning() & (F.col("ts_s") >= now - seconds)).agg(
        F.count("*").alias("bans"))


COUNTED = ("keyword_blacklist", "forward_whitelist", "blacklist", "chat_whitelist",
           "username_whitelist", "phone_whitelist")


def list_counts(lists: dict[str, DataFrame]) -> DataFrame:
    """Entries per list and scope; scope 0 is the list shared by all chats."""
    rows = reduce(DataFrame.unionByName, [
        lists[n].select("chat_id", F.lit(n).alias("list")) for n in COUNTED])
    counts = rows.groupBy("chat_id").pivot("list", list(COUNTED)).agg(F.count("list"))
    return counts.na.fill(0)


def status_report(offences: DataFrame, lists: dict[str, DataFrame], chats: DataFrame,
                  settings: DataFrame, cfg: ModerationConfig, now: int) -> DataFrame:
    """One row per managed chat: what was done, what is listed, what is in force."""
    counts = list_counts(lists).select("chat_id", "keyword_blacklist", "forward_whitelist",
                                       "blacklist")
    kinds = service_kinds(settings, chats, cfg).select(
        "chat_id", F.array_join(F.array_sort("kinds"), ",").alias("service_kinds"))
    action = effective_config(settings, cfg).select("action").scalar()
    out = (chats.select("chat_id", "title").join(chat_stats(offences, now), "chat_id", "left")
           .join(counts, "chat_id", "left").join(kinds, "chat_id", "left"))
    return out.na.fill(0).withColumn("action", action)


IN_CHAT = ("member", "administrator", "owner", "restricted")


def _candidates(starters: DataFrame, memberships: DataFrame, bot_admins: DataFrame,
                owners: tuple[int, ...], chats: DataFrame) -> DataFrame:
    people = starters.filter(~F.col("user_id").isin(*owners)) if owners else starters
    people = people.join(broadcast_if_small(bot_admins.select("user_id").distinct()),
                         "user_id", "left_anti")
    here = (memberships.filter(F.col("status").isin(*IN_CHAT))
            .join(broadcast_if_small(chats.select("chat_id").distinct()), "chat_id", "left_semi")
            .groupBy("user_id").agg(F.count_distinct("chat_id").alias("chats")))
    return people.join(here, "user_id", "left").withColumn("chats", F.coalesce("chats", F.lit(0)))


def seeding_flags(starters: DataFrame, memberships: DataFrame, bot_admins: DataFrame,
                  forwarders: DataFrame, chats: DataFrame, owners: tuple[int, ...] = (),
                  at_least: int | None = None) -> DataFrame:
    """Accounts that wrote to the moderator, with the managed chats they are in and a flag."""
    people = _candidates(starters, memberships, bot_admins, owners, chats)
    have = forwarders.filter(F.col("chat_id") == GLOBAL).select(
        "user_id", F.lit(True).alias("_have")).distinct()
    limit = (F.lit(max(1, at_least)) if at_least is not None else
             chats.select(F.floor(F.count_distinct("chat_id") * 2 / 3)).scalar())
    flag = (F.when(F.col("_have"), "already").when(F.col("chats") >= limit, "qualifies")
            .otherwise("few"))
    return people.join(have, "user_id", "left").withColumn("flag", flag).drop("_have")


def seeding_candidates(flags: DataFrame, shown: int = 40) -> DataFrame:
    """The report: most chats first, latest first among equals."""
    return flags.orderBy(F.desc("chats"), F.desc("ts_s"), "user_id").limit(shown).select(
        "user_id", "name", "username", "chats", "flag")


def accept_candidates(flags: DataFrame, forwarders: DataFrame) -> DataFrame:
    """The forward list with everybody who qualifies added for all chats."""
    new = flags.filter("flag = 'qualifies'").select(
        F.lit(GLOBAL).cast("bigint").alias("chat_id"), "user_id")
    return forwarders.select("chat_id", "user_id").unionByName(new).distinct()


def undo_last_ban(offences: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(offences left, the ban taken back)``: the sender's record in that chat is wiped."""
    row = F.struct("chat_id", "user_id", "name", "reasons")
    last = offences.filter(_banning()).agg(
        F.max_by(row, F.struct("ts_s", "id")).alias("last")).filter("last IS NOT NULL").select(
        "last.*")
    left = offences.join(F.broadcast(last.select("chat_id", "user_id")), ["chat_id", "user_id"],
                         "left_anti")
    return left, last


def list_view(entries: DataFrame, value: str, chat_id: int) -> DataFrame:
    """Shared and own entries side by side, sorted."""
    scope = F.when(F.col("chat_id") == GLOBAL, "shared").otherwise("own")
    return (entries.filter(F.col("chat_id").isin(GLOBAL, chat_id))
            .select(scope.alias("scope"), F.col(value).alias("entry")).distinct()
            .orderBy(F.desc("scope"), "entry"))


def explain_messages(msgs: DataFrame, keywords: DataFrame, blacklist: DataFrame,
                     forwarders: DataFrame, chats: DataFrame, cfg: ModerationConfig,
                     mode: str = "dry_run") -> DataFrame:
    """Scores and notes without acting.

    ``dry_run`` scores with the base configuration: no newcomer rules, no question
    exemption, no sender name, and none of the chat's own lists.  ``live`` takes the message
    columns as they are.
    """
    m = with_defaults(msgs)
    if mode == "dry_run":
        m = m.drop("allow_domains", "allow_usernames", "allow_phones").withColumns({
            "is_new_member": F.lit(False), "is_question": F.lit(False), "sender_name": F.lit("")})
    # the note about forwarding is given to blocked senders too
    m = forward_exempt(m.withColumn("is_blocked", F.lit(False)), forwarders).drop("is_blocked")
    m = blocked_sender(m, blacklist)
    if mode == "live":
        m = m.withColumn("is_forward", F.col("is_forward") & (
            ~F.col("may_forward") | F.col("is_blocked")))
    m = score_messages(m, cfg).withColumn("keep_text", normalize_keep_accents(F.concat_ws(
        " ", F.nullif("text", F.lit("")), F.nullif("caption", F.lit("")), "qr_payloads",
        F.nullif("ocr_text", F.lit("")))))
    m = with_banned_hits(m, keywords)
    label = (F.when(F.size("banned_hits") > 0, "spam: banned phrase")
             .when(F.col("is_blocked"), "spam: blocked")
             .when(F.col("verdict.is_spam"), "spam").otherwise("clean"))
    note = (F.when(F.size("banned_hits") > 0, F.array_join(F.slice("banned_hits", 1, 5), ", "))
            .when(F.col("is_blocked"), "blocked sender")
            .when(F.col("may_forward"), "may forward").otherwise(""))
    return m.select("message_id", "chat_id", label.alias("label"), note.alias("note"), "verdict")


def detection_quality(verdicts: DataFrame, labels: DataFrame) -> DataFrame:
    """Misses and false alarms of ``(id, is_spam)`` against ``(id, expected)``, per label."""
    return verdicts.join(labels, "id").groupBy("expected").agg(
        F.count("*").alias("messages"), F.count_if("is_spam").alias("flagged"),
        F.count_if(F.col("is_spam") != F.col("expected")).alias("failures"))


def panel_summary(settings: DataFrame, offences: DataFrame, cfg: ModerationConfig,
                  now: int) -> DataFrame:
    """One row: state, minutes of pause left, bans in the last hour, recent brake."""

    def stored(key: str) -> Column:
        return F.max(F.when(F.col("key") == key, F.expr("try_cast(value AS BIGINT)")))

    left = F.col("_until") - now
    out = settings.agg(stored("pause_until").alias("_until"), stored("brake_at").alias("_brake"))
    out = out.withColumn("action", effective_config(settings, cfg).select("action").scalar())
    return out.select(
        F.when(left > 0, "paused").when(F.col("action") == "report", "trial")
        .otherwise("protecting").alias("state"), "action",
        F.when(left > 0, F.floor(left / 60)).alias("minutes_left"),
        recent_ban_count(offences, now, 3600).scalar().alias("bans_last_hour"),
        F.coalesce((F.col("_brake") > 0) & (F.lit(now) - F.col("_brake") < DAY),
                   F.lit(False)).alias("braked_today"))


def preset_summary(presets: DataFrame) -> DataFrame:
    return presets.groupBy("name", "label").agg(F.count("*").alias("phrases"))


# --- what is written out ------------------------------------------------------------

EXCERPT, NAME, REPORT_EXCERPT = 400, 80, 300  # fixed values
NO_TEXT = "<không có chữ>"  # fixed value


def moderation_report(verdicts: DataFrame) -> DataFrame:
    """A readable row per verdict: who did what, and why, without the points."""
    who = F.coalesce(
        F.when(F.col("username").isNotNull(),
               F.concat(F.col("sender_name"), F.lit(" (@"), F.col("username"), F.lit(")"))),
        F.col("sender_name"), F.col("channel_title"), F.lit("?"))
    body = F.coalesce(F.nullif("text", F.lit("")), F.nullif("caption", F.lit("")), F.lit(NO_TEXT))
    why = F.transform("verdict.reasons", lambda r: E.strip_spaces(
        F.regexp_replace(r, r"\s*\(\+\d+\)\s*$", "")))
    return verdicts.select(
        "message_id", "chat_id", F.upper("action").alias("action"), who.alias("who"),
        F.coalesce("offender_id", F.lit(0)).alias("offender_id"),
        F.array_join(why, "; ").alias("why"), F.substring(body, 1, REPORT_EXCERPT).alias("excerpt"))


def offence_rows(verdicts: DataFrame) -> DataFrame:
    """Rows for the offence log; every action is logged, also ``report`` and ``delete``."""
    body = F.coalesce(F.nullif("text", F.lit("")), F.col("caption"), F.lit(""))
    return verdicts.select(
        "chat_id", F.coalesce("offender_id", F.lit(0)).alias("user_id"), "ts_s",
        F.col("verdict.score").alias("score"), "action",
        F.array_join("verdict.reasons", "; ").alias("reasons"),
        F.substring(body, 1, EXCERPT).alias("excerpt"),
        F.substring(F.coalesce("sender_name", F.lit("")), 1, NAME).alias("name"), "message_id")
